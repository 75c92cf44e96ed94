"""Writing the texts of a corpus to files, one file per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweight.functions.text import NULL_FOLDER


def _write(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write rows that are sorted by document. Everything that it needs is imported here, as it runs on the
    workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import re
        from itertools import groupby

        import pyarrow as pa
        from pyarrow import fs

        scheme, _, rest = path.partition("://")
        # Spark writes local paths as file:/a, file:///a and /a.
        local = scheme == path or scheme == "file"
        top = path.removeprefix("file:") if scheme == path else rest

        def rows() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                documents, texts = batch.columns
                for i in range(batch.num_rows):
                    yield documents[i].as_py(), texts[i].as_py()

        number = 0
        for document, lines in groupby(rows(), key=lambda r: r[0]):
            # What Spark escapes in the names of its folders.
            name = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", document)
            folder = f"{top}/document={name}"
            if local:
                os.makedirs(folder, exist_ok=True)
                # Another attempt of this task may write the same file: it appears as a whole.
                with open(f"{folder}/.text-{os.getpid()}", "wb") as file:
                    file.writelines(part for _, text in lines for part in (text, b"\n"))
                os.replace(file.name, f"{folder}/text")
            else:
                host, _, inner = folder.partition("/")
                system, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
                at = f"{base.rstrip('/')}/{inner}"
                system.create_dir(at)
                with system.open_output_stream(f"{at}/text") as file:
                    for _, text in lines:
                        file.write(text + b"\n")
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["files"])

    return run


def write_documents(corpus: DataFrame, path: str) -> None:
    """Write each document to a file ``document=<name>/text`` below ``path``, its rows as lines in any order; a
    null text is an empty line.

    The tasks write the files themselves: Spark's own writer takes milliseconds for each file of a folder of
    its own, in tasks and then, one after the other, to commit it. Names are those that Spark gives to folders:
    special characters are escaped, and documents without a name share a folder. Other systems than local
    files are opened with pyarrow, which must know them.
    """
    spark = corpus.sparkSession
    # The folder itself: without rows there are no folders of documents, and no file beside them.
    spark.createDataFrame([], "value string, document string").write.partitionBy("document").text(path)
    named = corpus.select(
        F.coalesce(F.nullif("document", F.lit("")), F.lit(NULL_FOLDER)).alias("document"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    together = named.repartition("document").sortWithinPartitions("document")
    together.mapInArrow(_write(path), "files bigint").write.format("noop").mode("overwrite").save()
