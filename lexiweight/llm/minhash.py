"""Near-duplicate documents by consistent weighted sampling of TF-IDF shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweight.llm import words as W
from lexiweight.llm.graph import components
from lexiweight.llm.shared import saved, ship

# Words of a shingle, and the weighted Jaccard similarity from which texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
# Two texts of that similarity share a band with a probability of 1 - (1 - 0.8^4)^12 = 0.998.
BANDS, ROWS = 12, 4
# Shingles in a smaller share of the different texts all get the same, highest weight.
RARE = 0.1
# Counters of a row of the sketch of document frequencies, and slices that are added up apart.
COUNTERS, SLICES = 1 << 19, 64
# Up to so many document ids are broadcast (8 MB); a longer list is joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000

_KEY_BITS = 48


@dataclass
class Shingles:
    """Distinct shingles of a block's texts, in order of text and key, and how often they occur."""

    key: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    prints: np.ndarray
    words: np.ndarray


def shingles(block: W.Block, size: int = SHINGLE) -> Shingles:
    """Shingles of ``size`` words; a shorter text is one shingle. ``prints`` tell word sequences apart."""
    found = W.split(block)
    hashes = W.word_hashes(block, found)
    rows = len(block.rows)
    prints = np.zeros((2, rows), np.uint64)
    some = np.flatnonzero(found.count)
    if len(some):
        edges = (np.cumsum(found.count) - found.count)[some]
        with np.errstate(over="ignore"):
            for i in range(2):
                factor = W.stream(20 + i, int(found.count.max())) | np.uint64(1)
                prints[i, some] = W.mix(np.add.reduceat(W.mix(hashes ^ factor[0]) * factor[found.at], edges))
    at = W.whole_windows(found, size)
    short = np.flatnonzero((found.count > 0) & (found.count < size))
    key = np.concatenate([W.window_hashes(hashes, size)[at], prints[0, short]]) >> np.uint64(64 - _KEY_BITS)
    doc = np.concatenate([found.doc[at], short]).astype(np.uint64)
    code = (doc << np.uint64(_KEY_BITS)) | key
    code.sort()
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(code)))
    code = code[first]
    mask = np.uint64((1 << _KEY_BITS) - 1)
    return Shingles(code & mask, count, (code >> np.uint64(_KEY_BITS)).astype(np.int64), prints, found.count)


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(COUNTERS - 1)
    return (key & mask).astype(np.int64), ((key >> np.uint64(_KEY_BITS // 2)) & mask).astype(np.int64)


@dataclass
class Frequencies:
    """Inverse document frequency of shingles, from a count-min sketch over all different texts.

    The sketch has a fixed size, so it can be broadcast whatever the corpus. It never counts too
    little, and too much by about (shingles of a document / COUNTERS) of all documents: far less
    than the share ``RARE``, up to which all shingles weigh the same.
    """

    counts: np.ndarray
    tables: np.ndarray

    def weight(self, found: Shingles) -> np.ndarray:
        a, b = _places(found.key)
        return found.count * np.maximum(self.tables[0][a], self.tables[1][b])

    def documents(self, found: Shingles) -> np.ndarray:
        """About how many different texts hold each shingle."""
        a, b = _places(found.key)
        return np.minimum(self.counts[0][a], self.counts[1][b])


def _different(texts: DataFrame) -> DataFrame:
    """``(text)``: each sequence of words once. Only texts that occur again are shuffled."""
    words = F.trim(F.regexp_replace(F.col("text").cast("string"), r"[\x20\x09-\x0D]+", " "))
    named = texts.select("text", F.md5(words).alias("print"))
    again = named.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = _few(saved(again.select("print"), "again"))
    once = named.join(again, "print", "left_semi").dropDuplicates(["print"])
    return named.join(again, "print", "left_anti").unionByName(once).select("text")


def document_frequencies(texts: DataFrame, rare: float = RARE) -> Frequencies:
    """Count all different texts, so that exact copies do not make their words frequent: 2 x COUNTERS
    sums come to the driver, as a fixed number of slices."""
    width = COUNTERS // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, documents = np.zeros((2, COUNTERS), np.int64), 0
        for batch in batches:
            for block in W.blocks(batch.column("text")):
                found = shingles(block)
                documents += int((found.words > 0).sum())
                for row, place in zip(sketch, _places(found.key), strict=True):
                    row += np.bincount(place, minlength=COUNTERS)
        if documents:
            rows = [
                {"slice": i, "documents": documents, "counts": sketch[:, i * width : (i + 1) * width].tobytes()}
                for i in range(SLICES)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_SLICES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = sums.setdefault(row["slice"], [0, np.zeros(2 * width, np.int64)])
                own[0] += row["documents"]
                own[1] += np.frombuffer(row["counts"], np.int64)
        rows = [{"slice": i, "documents": n, "counts": c.tobytes()} for i, (n, c) in sums.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=_SLICES)

    names = "slice int, documents bigint, counts binary"
    slices = _different(texts).mapInArrow(count, names).repartition(SLICES, "slice").mapInArrow(add, names).collect()
    total = max([1, *(s["documents"] for s in slices)])
    counts = np.zeros((2, COUNTERS), np.int64)
    for s in slices:
        counts[:, s["slice"] * width : (s["slice"] + 1) * width] = np.frombuffer(s["counts"], np.int64).reshape(2, width)
    share = np.clip(counts / total, rare, 1)
    return Frequencies(np.minimum(counts, 2**31 - 1).astype(np.int32), (1 - np.log(share)).astype(np.float32))


_SLICES = pa.schema([("slice", pa.int32()), ("documents", pa.int64()), ("counts", pa.binary())])

_LOG12 = np.log((np.arange(1 << 12, dtype=np.float32) + np.float32(0.5)) / np.float32(1 << 12))
_LOG16 = np.log((np.arange(1 << 16, dtype=np.float32) + np.float32(0.5)) / np.float32(1 << 16))


def _sample(key: np.ndarray, log_weight: np.ndarray, edges: np.ndarray, seed: np.uint64) -> np.ndarray:
    """One improved consistent weighted sample of every text: a hash of the drawn shingle and of
    its quantized weight. Two texts draw the same with the probability of their similarity."""
    with np.errstate(over="ignore"):
        bits = W.mix(key + seed)
    part = lambda shift, size: ((bits >> np.uint64(shift)) & np.uint64((1 << size) - 1)).view(np.int64)
    # r and c are Gamma(2, 1), the shift is uniform; all depend on the shingle and the seed only.
    r = -(_LOG12[part(52, 12)] + _LOG12[part(40, 12)])
    log_c = np.log(-(_LOG16[part(24, 16)] + _LOG16[part(8, 16)]))
    shift = part(0, 8).astype(np.float32) * np.float32(1 / 256)
    level = np.floor(log_weight / r + shift)
    value = log_c - r * (level - shift + np.float32(1))
    least = np.minimum.reduceat(value, edges)
    drawn = np.flatnonzero(value == np.repeat(least, np.diff(np.append(edges, len(key)))))
    which = np.searchsorted(drawn, edges)
    drawn = drawn[which]
    with np.errstate(over="ignore"):
        return W.mix(key[drawn] ^ W.mix(level[drawn].astype(np.int64).view(np.uint64) + seed))


def signatures(found: Shingles, frequencies: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    """Total weight and band keys (BANDS x texts) of the texts that have shingles."""
    weight = frequencies.weight(found)
    edges = np.flatnonzero(np.append(True, found.doc[1:] != found.doc[:-1]))
    log_weight = np.log(weight).astype(np.float32)
    seeds = W.stream(30, BANDS * ROWS)
    bands = np.zeros((BANDS, len(edges)), np.uint64)
    for i, seed in enumerate(seeds):
        own = bands[i // ROWS]
        with np.errstate(over="ignore"):
            own[:] = W.mix(own * np.uint64(3) + _sample(found.key, log_weight, edges, seed))
    return np.add.reduceat(weight, edges), bands


def _signed(frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column("text")):
                found = shingles(block)
                some = np.flatnonzero(found.words)
                if not len(some):
                    continue
                weight, bands = signatures(found, frequencies.value)
                ids = batch.column("doc_id").slice(block.rows.start, len(block.rows)).take(pa.array(some))
                counts = np.full(len(some), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        *(pa.array(found.prints[i, some].view(np.int64)) for i in range(2)),
                        pa.array(weight.astype(np.float64)),
                        W.lists(bands.T.reshape(-1).view(np.int64), counts, pa.int64()),
                    ],
                    names=["doc_id", "print1", "print2", "weight", "bands"],
                )

    return run


def _similarity(frequencies):
    """Weighted Jaccard similarity of the texts of each pair."""

    def vectors(texts: list[str], known: dict) -> None:
        for block in W.blocks(pa.array(texts, pa.string())):
            found = shingles(block)
            weight = frequencies.value.weight(found)
            edges = np.searchsorted(found.doc, np.arange(len(block.rows) + 1))
            for i, row in enumerate(block.rows):
                own = slice(edges[i], edges[i + 1])
                known[texts[row]] = found.key[own], weight[own], weight[own].sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                known: dict[str, tuple] = {}
                sides = [part.column(c).to_pylist() for c in ("text_a", "text_b")]
                vectors(list(dict.fromkeys(sides[0] + sides[1])), known)
                values = []
                for a, b in zip(*sides, strict=True):
                    (x, v, v_sum), (y, w, w_sum) = known[a], known[b]
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    same = y[at] == x if len(y) else np.zeros(len(x), bool)
                    common = np.minimum(v[same], w[at[same]]).sum()
                    values.append(float(common / (v_sum + w_sum - common)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array(values, pa.float64())],
                    names=["a", "b", "similarity"],
                )

    return run


def _few(ids: DataFrame) -> DataFrame:
    """A list of ids, to be broadcast if it is short."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


# Ratio of the sizes between which texts count as equally large.
_SIZE_STEP = 1.04


def _prefixes(frequencies, similarity: float):
    """The rare shingles of each text of which any similar text must have one.

    Shingles are put in one order, from rare to frequent. If x and y have no shingle in common before
    some place in either, their overlap is at most the weight that follows there; but texts of the
    given similarity t overlap by t / (1 + t) * (|x| + |y|). So only shingles with that much weight
    from them on can be the first common one. A text is listed with those that count for partners
    of its own size or more, and looks up, for each smaller size, those that count for that size.
    """
    part = similarity / (1 + similarity)

    def size_class(size: float) -> int:
        return int(np.floor(np.log(size) / np.log(_SIZE_STEP)))

    def rows_of(rep: int, own_class: int, found: Shingles, weight: np.ndarray, order: np.ndarray) -> Iterator[dict]:
        key, weight = found.key[order], weight[order]
        size = weight.sum()
        rest = np.cumsum(weight[::-1])[::-1]

        def listed(needed: float, level: int, probe: bool) -> dict:
            n = int((rest >= needed - 1e-6 * size).sum())
            common = {"rep": rep, "class": own_class, "size": float(size), "level": level, "probe": probe}
            return common | {"keys": key[:n].view(np.int64), "rest": rest[:n].astype(np.float64)}

        yield listed(2 * part * size, size_class(size), False)
        for level in range(size_class(similarity * size * (1 - 1e-6)), size_class(size) + 1):
            yield listed(part * (size + _SIZE_STEP**level), level, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, classes = batch.column("rep").to_pylist(), batch.column("class").to_pylist()
            for block in W.blocks(batch.column("text")):
                found = shingles(block)
                weight = frequencies.value.weight(found).astype(np.float64)
                order = np.lexsort((found.key, frequencies.value.documents(found), found.doc))
                edges = np.searchsorted(found.doc, np.arange(len(block.rows) + 1))
                rows = []
                for i, row in enumerate(block.rows):
                    own = order[edges[i] : edges[i + 1]]
                    rows += rows_of(reps[row], classes[row], found, weight, own) if len(own) else []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PREFIX_ARROW)

    return run


_PREFIX = "rep bigint, class bigint, size double, level int, probe boolean, keys array<bigint>, rest array<double>"
_PREFIX_ARROW = pa.schema(
    [
        ("rep", pa.int64()),
        ("class", pa.int64()),
        ("size", pa.float64()),
        ("level", pa.int32()),
        ("probe", pa.bool_()),
        ("keys", pa.list_(pa.int64())),
        ("rest", pa.list_(pa.float64())),
    ]
)


def _between_classes(texts: DataFrame, frequencies, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts in different classes that may be similar; all others can't be.

    ``texts`` is (rep, class, text). Of texts that share a rare shingle, those of the most frequent
    class are not joined with each other, so a large class costs no more than its rows.
    """
    rows = saved(texts.mapInArrow(_prefixes(frequencies, similarity), _PREFIX), "prefixes")
    rows = rows.select("rep", "class", "size", "level", "probe", F.explode(F.arrays_zip("keys", "rest")).alias("at"))
    rows = rows.select("rep", "class", "size", "level", "probe", F.col("at.keys").alias("key"), F.col("at.rest").alias("rest"))
    held, asked = rows.filter("not probe").drop("probe"), rows.filter("probe").drop("probe")
    place = ["key", "level"]
    sizes = held.groupBy(*place, "class").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy(*place).agg(F.max_by("class", "n").alias("main"), F.count(F.lit(1)).alias("classes"))
    held = held.join(main.drop("classes"), place).withColumn("other", F.col("class") != F.col("main"))
    asked = asked.join(main, place).filter((F.col("classes") > 1) | (F.col("class") != F.col("main")))
    kinds = F.when(F.col("class") == F.col("main"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))
    asked = asked.withColumn("other", F.explode(kinds)).drop("main", "classes")
    left = asked.toDF(*(c if c in (*place, "other") else f"{c}_x" for c in asked.columns))
    right = held.drop("main").toDF(*(c if c in (*place, "other") else f"{c}_y" for c in held.drop("main").columns))
    needed = similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) * (1 - 1e-6)
    smaller = (F.col("size_y") < F.col("size_x")) | ((F.col("size_y") == F.col("size_x")) & (F.col("rep_y") < F.col("rep_x")))
    both = left.join(right, [*place, "other"]).filter(
        (F.col("class_x") != F.col("class_y")) & smaller & (F.least("rest_x", "rest_y") >= needed)
    )
    return both.select(*_ordered("rep_x", "rep_y"))


def _measured(pairs: DataFrame, members: DataFrame, texts: DataFrame, frequencies, similarity: float) -> DataFrame:
    """``(a, b, similarity)`` of different pairs (a, b), a < b, but for those that the weights of
    the texts rule out: the smaller over the larger one bounds the similarity."""
    size = members.select("rep", "weight").distinct()
    new = pairs.distinct().join(size.toDF("a", "weight_a"), "a").join(size.toDF("b", "weight_b"), "b")
    bound = F.least("weight_a", "weight_b") / F.greatest("weight_a", "weight_b")
    new = saved(new.filter(bound >= similarity - 1e-6).select("a", "b").distinct(), "pairs")
    rows = new.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
    return saved(rows.mapInArrow(_similarity(frequencies), "a bigint, b bigint, similarity double"), "similarities")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _classes(reps: DataFrame, texts: DataFrame, frequencies, similarity: float) -> DataFrame:
    """``(rep, class)`` of all different texts that are linked to another one."""
    banded = reps.select("doc_id", "weight", F.posexplode("bands").alias("number", "key"))
    banded = banded.select(F.col("doc_id").alias("rep"), "weight", F.xxhash64("number", "key").alias("band"))
    groups = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = saved(banded.join(groups, "band"), "members")
    # The hub of a band is the text that shares its bands with most others: the one that the others
    # were made from, if there is one.
    central = members.groupBy("rep").agg(F.sum("n").alias("neighbours"))
    placed = members.join(central, "rep")
    hubs = placed.groupBy("band").agg(F.max_by("rep", F.struct("neighbours", -F.col("rep"))).alias("hub"))
    listed = _few(members.select(F.col("rep").alias("doc_id")).distinct())
    own = texts.join(listed, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    own = saved(own.dropDuplicates(["rep", "text"]), "texts")

    starred = members.select("band", "rep").join(hubs, "band").filter("rep <> hub")
    known = _measured(starred.select(*_ordered("rep", "hub")), members, own, frequencies, similarity)
    links = known.filter(F.col("similarity") >= similarity).select("a", "b")
    classes = saved(components(links).toDF("rep", "class"), "classes")

    classed = members.select("band", "rep").join(classes, "rep", "left")
    classed = classed.select("band", "rep", F.coalesce("class", "rep").alias("class"))
    spread = classed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = classed.join(spread.filter("low < high").select("band"), "band").select("rep", "class").distinct()
    between = _between_classes(own.join(mixed, "rep").select("rep", "class", "text"), frequencies, similarity)
    more = _measured(between, members, own, frequencies, similarity)
    more = more.filter(F.col("similarity") >= similarity)
    if more.isEmpty():
        return classes
    # The classes that these pairs link become one; a text without a class so far stands for itself.
    for side in ("a", "b"):
        more = more.join(classes.toDF(side, f"class_{side}"), side, "left")
    merged = more.select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    merged = components(merged).toDF("old", "new")
    renamed = classes.join(merged.withColumnRenamed("old", "class"), "class", "left")
    renamed = renamed.select("rep", F.coalesce("new", "class").alias("class"))
    first = merged.toDF("rep", "class").join(classes.select("rep"), "rep", "left_anti")
    return renamed.unionByName(first)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, class_id, kept)``: a row for each row of ``docs`` with the class of its near-copies.

    Texts are multisets of shingles, weighted by their number and by 1 - ln(share of different texts
    that hold them), the share counted from ``RARE`` up. Two texts are linked if they share a band
    of samples, or lie in mixed bands as below, and their weighted Jaccard similarity is
    ``similarity`` or more; a class holds all texts that links connect, and is named by its
    smallest ``doc_id``, the one document kept.

    Equal word sequences are one text from the start. Within a band, every text is compared with
    the most central one, and not all with all. Where that leaves texts of one band in different
    classes, all pairs between classes that can be similar are compared: those that have a
    rare shingle in common, early enough in either for the rest to reach the overlap that the
    similarity takes. So no link between classes is lost, and a large group of near-copies takes a
    pass over its rows.

    Rows without ``doc_id`` or without a word are compared with nothing and kept, with their own
    id as class. Repeated rows fall into one class and are all marked kept if their id is its
    smallest; see ``drop_near_duplicates``. Different texts under one id are one document, which is
    linked to whatever one of them is linked to. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    everything = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = everything.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    frequencies = spark.sparkContext.broadcast(document_frequencies(texts))
    schema = "doc_id bigint, print1 bigint, print2 bigint, weight double, bands array<bigint>"
    signed = saved(texts.mapInArrow(_signed(frequencies), schema), "signatures")
    prints = ["print1", "print2"]
    copies = saved(signed.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "copies")
    reps = signed.join(copies.select(F.col("rep").alias("doc_id"), *prints), ["doc_id", *prints])
    reps = reps.dropDuplicates(["doc_id", *prints])
    classes = saved(_classes(reps, texts, frequencies, similarity), "classes")
    classed = signed.select("doc_id", *prints).join(copies, prints).join(classes, "rep", "left")
    classed = classed.select("doc_id", F.coalesce("class", "rep").alias("class_id"))
    alone = everything.filter(F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"))
    rows = classed.unionByName(alone)
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class of near-copies: the one with the smallest id.

    Rows that repeat both id and text stay once; all other columns are as they were.
    """
    classes = saved(near_duplicates(docs, similarity), "classes")
    gone = _few(classes.filter(~F.col("kept")).select("doc_id").distinct())
    left = docs.join(gone, "doc_id", "left_anti")
    again = classes.filter("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = saved(again.select("doc_id"), "repeated")
    if again.isEmpty():
        return left
    again = _few(again)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once)
