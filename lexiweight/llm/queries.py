"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweight.llm import quality, toxicity, warc
from lexiweight.llm.bpe import encode_decode
from lexiweight.llm.cells import near_vectors
from lexiweight.llm.collisions import nearest
from lexiweight.llm.collocations import collocations
from lexiweight.llm.fingerprints import compare_with_next
from lexiweight.llm.labelled import held_out
from lexiweight.llm.minhash import near_duplicates
from lexiweight.llm.mixing import mix
from lexiweight.llm.runs import periodic_runs
from lexiweight.llm.sharding import assign_shards
from lexiweight.llm.substring import remove_repeats

# The scores from which a document counts as label 1.
GOOD_FROM, TOXIC_FROM = 0.3, 0.5
# Bytes of a shard: little enough for the tables at hand to be split.
SHARD_BYTES = 1 << 20
# The twenty sources in equal parts; all others together get one more.
SOURCE_WEIGHTS = {f"src{i}": 1.0 for i in range(20)} | {"": 1.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _scored(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    space = quality.fit(docs, _table(spark, sf_dir, "labels"), "quality")
    return _scored(quality.score(docs, space, ["doc_id"]), GOOD_FROM)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    classifier = toxicity.fit(docs, _table(spark, sf_dir, "labels"), "toxic")
    return _scored(toxicity.score(docs, classifier, ["doc_id"]), TOXIC_FROM)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(_table(spark, sf_dir, "documents"), SHARD_BYTES).drop("row")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("tokens", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of about a tenth of the documents made periodic from some word on; which,
    where and with what period depends on a checksum of ``doc_id``. Those texts have single blanks."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    changed = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w"))
    g = F.floor(F.col("h") / 10)
    a = g % F.col("n")
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))
    changed = changed.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", period)
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))
    text = F.array_join(F.transform(at, lambda i: F.get("w", i.cast("int"))), " ")
    return changed.select(*(F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs(with_repeats(docs)).select("doc_id", "runs", "collapsed")
    # The longest; of equal ones the first, then that of the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    columns = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return columns.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_toxicity": op2_toxicity,
        "op3_warc": op3_warc,
        "op4_sharding": op4_sharding,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_bpe": op7_bpe,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_source_mixing": op9_source_mixing,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_collocations": op12_collocations,
        "op13_fingerprints": op13_fingerprints,
    }


def sharding_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
        with hashed as (
            select row_number() over () as number, doc_id, coalesce(strlen(text), 0) as bytes,
                lpad(bin(cast('0x' || substr(md5(concat(cast(doc_id as varchar), ':', text)), 1, 15) as bigint)),
                    60, '0') as bits
            from documents),
        levels as (select *, unnest(range(0, 61)) as depth from hashed),
        sizes as (
            select depth, substr(bits, 1, depth) as shard, cast(sum(bytes) as bigint) as shard_bytes, count(*) as n
            from levels group by depth, shard),
        fitting as (
            select number, doc_id, bytes, shard, depth, shard_bytes,
                row_number() over (partition by number order by depth) as place
            from levels join sizes using (depth)
            where shard = substr(bits, 1, depth) and (shard_bytes <= {limit} or n = 1))
        select doc_id, bytes, shard, cast(depth as int) as depth, shard_bytes from fitting where place = 1"""


def mixing_sql(weights: dict[str, float] | None = None, seed: int = 0) -> str:
    weights = weights or SOURCE_WEIGHTS
    total = sum(weights.values())
    values = ", ".join(f"('{s}', {w / total!r}::double)" for s, w in weights.items())
    return f"""
        with recursive shares(key, share) as (values {values}),
        rows as (
            select *, case when source in (select key from shares) then source else '' end as key from documents),
        sizes as (select key, sum(coalesce(strlen(text), 0)) as bytes from rows group by key),
        rates as (
            select key, case when bytes > 0 then
                1.0::double * (select sum(bytes) from sizes)::double * coalesce(share, 0) / bytes::double else 1.0 end as rate
            from sizes left join shares using (key)),
        parts as (select key, greatest(ceil(rate / 256.0::double), 1) as parts, rate from rates),
        below as (
            select key, parts, rate / parts as mean, 0 as k, exp(-(rate / parts)) as p, exp(-(rate / parts)) as below
            from parts
            union all
            select key, parts, mean, k + 1, p * mean / (k + 1), below + p * mean / (k + 1) from below
            where k < ceil(mean + 12 * sqrt(mean) + 30)),
        draws as (
            select rows.*, unnest(range(1, parts::bigint + 1)) as part from rows join parts using (key)),
        uniform as (
            select *, cast('0x' || substr(md5(concat('{seed}:', doc_id, ':', part)), 1, 13) as bigint) / 4503599627370496.0::double as u
            from draws),
        copies as (
            select doc_id, cast(sum((select count(*) from below b where b.key = uniform.key and b.below <= u)) as bigint) as copies
            from uniform group by doc_id)
        select documents.*, cast(unnest(range(1, copies + 1)) as int) as copy from documents join copies using (doc_id)"""


def periodic_runs_sql(least: int = 6, power: int = 4) -> str:
    return rf"""
        with bytes as (
            select list(code order by i) as code from (
                select i, list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as code
                from range(256) t(i))),
        sums as (
            select doc_id, text, xor(list_reduce(list_prepend(4294967295, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]),
                lambda c, b: xor(code[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) as h
            from documents, bytes),
        split as (
            select doc_id, h, h // 10 as g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from sums),
        placed as (
            select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then g % len(w) end as a from split),
        words as (
            select doc_id, n, case when a is null then w else
                [w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end] for i in range(n)] end as w
            from placed),
        tokens as (select doc_id, n, unnest(range(n)) as i, unnest(w) as word from words),
        cells as (
            select x.doc_id, x.i, x.i - y.i as lag from tokens x join tokens y using (doc_id, word)
            where y.i < x.i and {power} * (x.i - y.i) <= x.n),
        islands as (select *, i - row_number() over (partition by doc_id, lag order by i) as island from cells),
        diagonals as (
            select doc_id, lag, min(i) - lag as start, count(*) + lag as length from islands group by doc_id, lag, island
            having count(*) + lag >= greatest({least}, {power} * lag)),
        runs as (select doc_id, start, length, min(lag) as period from diagonals group by doc_id, start, length),
        lines as (
            select doc_id, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines,
                first({{'start': start, 'length': length, 'period': period}} order by length desc, start, period) as best
            from runs group by doc_id),
        gone as (
            select doc_id, list(distinct i) as gone from (select doc_id, unnest(range(start + period, start + length)) as i from runs) group by doc_id)
        select doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.period as period,
            1000 * best.length // best.period as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
            sha256(array_to_string([w[i + 1] for i in range(n) if gone is null or not list_contains(gone, i)], ' ')) as collapsed_sha256
        from words left join lines using (doc_id) left join gone using (doc_id)"""


def collocations_sql(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    return rf"""
        with texts as (
            select coalesce(lang, 'und') as lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
        words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
        grams as (
            select lang, w, i, unnest(range(1, {longest} + 1)) as size from starts),
        phrases as (
            select lang, size, w[i:i + size - 1] as p, count(*) as f from grams where i + size - 1 <= len(w) group by all),
        totals as (select lang, cast(sum(f) as bigint) as n from phrases where size = 1 group by lang),
        frequent as (select * from phrases where f >= {least}),
        parts as (
            select lang, p[i:i + k - 1] as p, max(f) as longer from (
                select lang, p, f, size, k, unnest(range(1, size - k + 2)) as i
                from (select *, unnest(range(2, size)) as k from frequent)) group by all),
        candidates as (
            select f.* from frequent f left join parts using (lang, p) where size >= 2 and (longer is null or 100 * longer < 100 * f)),
        cuts as (select *, unnest(range(1, size)) as k from candidates),
        scored as (
            select c.lang, array_to_string(c.p, ' ') as phrase, c.f as a, x.f as l, y.f as r, n, k,
                1000::hugeint * c.f * n // (x.f::hugeint * y.f) as score
            from cuts c join totals using (lang)
                join frequent x on x.lang = c.lang and x.p = c.p[1:k]
                join frequent y on y.lang = c.lang and y.p = c.p[k + 1:]),
        lowest as (
            select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
            phrase, a, l, r, n, cast(score as bigint) as score
        from lowest qualify rank <= {top}"""


def fingerprints_sql(shingle: int = 5, k: int = 128) -> str:
    def sketch(text: str) -> str:
        words = rf"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
        hashes = f"[left(md5(array_to_string(w[i:i + {shingle - 1}], ' ')), 16) for i in range(1, greatest(len(w) - {shingle - 1}, 1) + 1) if len(w) > 0]"
        return f"(select list_sort(list_distinct({hashes}))[1:{k}] from (select {words} as w))"

    def union(a: str, b: str) -> str:
        return f"list_sort(list_distinct(list_concat({a}, {b})))[1:{k}]"

    def distinct(a: str) -> str:
        share = f"((cast('0x' || left({a}[-1], 13) as bigint) + 1)::double / 4503599627370496::double)"
        return f"case when len({a}) < {k} then len({a})::double else {k - 1}::double / {share} end"

    def alike(a: str, b: str, u: str) -> str:
        return f"case when len({u}) = 0 then 1.0::double else len(list_intersect({u}, list_intersect({a}, {b})))::double / len({u}) end"

    return f"""
        with texts as (select doc_id, coalesce(text, '') as text from documents),
        linked as (
            select *, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as following from texts),
        edited as (
            select *, length(text) as n, concat(substr(text, 1, length(text) - length(text) // 2), substr(following, 1, length(text) // 2)) as edited
            from linked),
        sketched as (
            select doc_id, n, edited, {sketch("text")} as s, {sketch("edited")} as e, {sketch("following")} as f from edited),
        unions as (select *, {union("s", "e")} as se, {union("s", "f")} as sf from sketched),
        likeness as (
            select *, {alike("s", "e", "se")} as near_edited, {alike("s", "f", "sf")} as near_next, {distinct("s")} as shingles, {distinct("se")} as united
            from unions)
        select doc_id, n as n_chars, sha256(edited) as edited_sha256, array_to_string(s, '') as fingerprint,
            array_to_string(e, '') as edited_fingerprint, near_edited, near_next, shingles,
            case when shingles = 0 then 1.0::double else least(1.0::double, near_edited * united / shingles) end as edited_holds
        from likeness"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc": """
            with pages_of as (
                select page_id, coalesce(html, '') as html from pages),
            firsts as (select html, min(page_id) as first from pages_of group by html),
            named as (select page_id, html, first, sha1(html) as hex from pages_of join firsts using (html)),
            bits as (
                select page_id, html, first, string_agg(lpad(bin(cast('0x' || substr(hex, i, 2) as bigint)), 8, '0'), '' order by i) as bits
                from (select *, unnest(range(1, 41, 2)) as i from named) group by page_id, html, first)
            select page_id, strlen(html) as payload_bytes,
                array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + list_sum([cast(substr(bits, 5 * j + b, 1) as int) * (1 << (5 - b)) for b in range(1, 6)])::bigint, 1)
                    for j in range(0, 32)], '') as payload_digest,
                case when page_id = first then 'response' else 'revisit' end as record_type,
                case when page_id > first then first end as refers_to
            from bits""",
        "op4_sharding": sharding_sql(),
        "op11_periodic_runs": periodic_runs_sql(),
        "op12_collocations": collocations_sql(),
        "op13_fingerprints": fingerprints_sql(),
        "op9_source_mixing": mixing_sql(),
        "op8_embedding_near_dedup": """
            with recursive vectors as (
                select vec_id, embedding::double[] as v from embeddings
                where len([x for x in embedding if x is null or not isfinite(x)]) = 0
                    and len([x for x in embedding if x <> 0]) > 0),
            links as (
                select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id
                where list_cosine_similarity(a.v, b.v) >= 0.95),
            reached as (
                select vec_id as a, vec_id as b from embeddings
                union
                select reached.a, links.b from reached join links on reached.b = links.a),
            parts as (select a as vec_id, min(b) as component_id from reached group by a),
            counts as (select a as vec_id, count(*) as n_links from links group by a)
            select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
            from parts left join counts using (vec_id)""",
        "op10_substring_dedup": r"""
            with words as (
                select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
            starts as (
                select doc_id, i, array_to_string(w[i:i + 12], ' ') as passage
                from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)),
            first as (select passage, min(doc_id) as doc_id from starts group by passage),
            gone as (
                select distinct s.doc_id, unnest(range(s.i, s.i + 13)) as i
                from starts s join first f on s.passage = f.passage and f.doc_id < s.doc_id),
            gone_list as (select doc_id, list(i) as places from gone group by doc_id)
            select words.doc_id, len(w) as n_words, coalesce(len(places), 0) as n_removed,
                sha256(array_to_string([w[i] for i in range(1, len(w) + 1)
                    if places is null or not list_contains(places, i)], ' ')) as kept_sha256
            from words left join gone_list using (doc_id)""",
    }
