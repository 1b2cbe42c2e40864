"""Operator 2: homomorphic multiset fingerprints of documents (native).

A text is cut into paragraphs (lines, sentences, and runs of at most 160 characters). Each paragraph hashes to a wide
vector; a document's vector is the sum over its paragraphs: 8 lanes of SHA-256 bits modulo 2^32, and 120 lanes of
plus or minus one (MD5 bits) modulo 2^16. Sums do not depend on the order, and paragraphs can be added or taken away
without reading the rest. Equal multisets have equal vectors; the inner product of the signed lanes estimates how many
paragraphs two documents share, so likeness is 2<a,b> / (|a|^2 + |b|^2), held within 0 and 1.

Scale: one shuffle of the texts, by ranges of doc_id. The range bounds are ids of the table, so the document after a
range is known by its id and copied to it; no global order is needed. The sums then stay in the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

EXACT, SIGNED = 8, 120
HALF = 30
PIECE = r"[^.!?\n]{1,160}[.!?]*|[.!?]+|\n"
RANGE_ROWS = 64
MOST_RANGES = 16384


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; line ends are pieces of their own; an empty text has one empty paragraph."""
    found = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(found)


def _word(h: Column, at: int) -> Column:
    return F.conv(F.substring(h, 8 * at + 1, 8), 16, 10).cast("long")


def with_words(rows: DataFrame) -> DataFrame:
    """Rows of paragraphs (piece) with the words of their vectors: e0 to e7 of 32 bits, s0 and s1 of 60 bits, one.

    Hashes come first in a projection of their own, so that each is computed once. Line ends do not count for likeness.
    """
    rows = rows.withColumn("strong", F.sha2("piece", 256)).withColumn("weak", F.md5(F.col("piece").cast("binary")))
    counts = F.col("piece") != "\n"
    return rows.select(
        *[c for c in rows.columns if c not in ("piece", "strong", "weak")],
        *[_word(F.col("strong"), i).alias(f"e{i}") for i in range(EXACT)],
        *[F.when(counts, F.conv(F.substring("weak", 15 * i + 1, 15), 16, 10).cast("long")).otherwise(0).alias(f"s{i}") for i in range(2)],
        counts.cast("long").alias("one"),
    )


def lane_sums() -> list[Column]:
    """Aggregates over with_words: sums of exact lanes, counts of set bits (two lanes a sum, 30 bits each), and of ones."""
    two = F.lit((1 << HALF) + 1)
    return [
        *[F.sum(f"e{i}").alias(f"e{i}") for i in range(EXACT)],
        *[F.sum(F.shiftright(f"s{i}", j).bitwiseAND(two)).alias(f"s{i}_{j}") for i in range(2) for j in range(HALF)],
        F.sum("one").alias("one"),
    ]


def lanes() -> tuple[Column, Column]:
    """Exact and signed lanes after the modulus, from lane_sums. Signed ones are centred on zero."""
    exact = F.array(*[F.pmod(F.col(f"e{i}"), F.lit(1 << 32)) for i in range(EXACT)])
    low = lambda i, j: F.col(f"s{i}_{j}").bitwiseAND(F.lit((1 << HALF) - 1))
    high = lambda i, j: F.shiftright(f"s{i}_{j}", HALF)
    counts = F.array(*[f(i, j) for i in range(2) for f in (low, high) for j in range(HALF)])
    signed = F.transform(counts, lambda c: (F.pmod(2 * c - F.col("one") + 32768, F.lit(65536)) - 32768).cast("int"))
    return exact, signed


def _hex(x: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(x)), digits, "0")


def fingerprint_text(exact: Column, signed: Column) -> Column:
    """Lanes as text: 8 hex digits for each exact lane, 4 for each signed one."""
    return F.concat(
        F.concat_ws("", F.transform(exact, lambda x: _hex(x, 8))),
        F.concat_ws("", F.transform(signed, lambda x: _hex(F.pmod(x, F.lit(65536)), 4))),
    )


def _lanes_of(text: Column, n: int, digits: int, at: int) -> Column:
    place = lambda i: F.substr(text, F.lit(at + 1) + i * digits, F.lit(digits))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(place(i), 16, 10).cast("long"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    parts = []
    for n, digits, at in ((EXACT, 8, 0), (SIGNED, 4, 8 * EXACT)):
        sums = F.zip_with(_lanes_of(a, n, digits, at), _lanes_of(b, n, digits, at), lambda x, y: F.pmod(x + sign * y, F.lit(1 << 4 * digits)))
        parts.append(F.concat_ws("", F.transform(sums, lambda x: _hex(x, digits))))  # noqa: B023
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(*parts))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of a and those of b together; null if either is."""
    return _combined(a, b, 1)


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of a without those of b, which it holds; null if either is."""
    return _combined(a, b, -1)


def fingerprint_paragraphs(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and fingerprint, from a row for each paragraph (piece): of texts in parts, or of what is to be added or removed.

    Partial sums are taken before the shuffle, so a key with most of the rows costs a few rows for each task. Null pieces
    count as empty ones.
    """
    sums = with_words(rows.select(*keys, F.coalesce("piece", F.lit("")).alias("piece"))).groupBy(*keys).agg(*lane_sums())
    return sums.select(*keys, fingerprint_text(*lanes()).alias("fingerprint"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def likeness(a: Column, b: Column, aa: Column, bb: Column, equal: Column) -> Column:
    """Share of common paragraphs as the signed lanes estimate it; 1 for equal fingerprints, 0 at least."""
    total = (aa + bb).cast("double")
    return F.when(equal, 1.0).when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * _dot(a, b).cast("double") / total)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    Null texts count as empty. The next document is the next row by doc_id, then text (null ids first); after the last
    comes the first. A table of one row is its own next document. Repeated rows are rows of their own.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, nulls, lowest = d.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    bounds: list[int] = []
    if ranges > 1 and lowest is not None:
        points = [i / ranges for i in range(1, ranges)]
        found = d.agg(F.percentile_approx("doc_id", points, 4 * ranges)).first()[0] or []
        bounds = sorted({int(x) for x in found if x > lowest or nulls})  # each is the first id of its range
    last = len(bounds)
    if bounds:
        held = F.array(*map(F.lit, bounds)).cast("array<bigint>")
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(last.bit_length()))])
        range_of = F.coalesce(
            F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= last) & (F.col("doc_id") >= F.get(held, at + step - 1)), at + step).otherwise(at)),
            F.lit(0),
        )
        range_of = F.when(F.col("doc_id").isNull(), 0).otherwise(range_of)
        d = d.withColumn("own", range_of)
        starts = (F.col("own") > 0) & (F.col("doc_id") == F.get(held, F.col("own") - 1))
    else:
        d = d.withColumn("own", F.lit(0))
        starts = F.lit(False)
    very_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(lowest)
    places = F.array(
        F.struct(F.col("own").alias("at"), F.lit(False).alias("halo")),
        F.when(starts, F.struct((F.col("own") - 1).alias("at"), F.lit(True).alias("halo"))),
        F.when(very_first, F.struct(F.lit(last).alias("at"), F.lit(True).alias("halo"))),
    )
    d = d.withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull()))).select("doc_id", "text", "place.at", "place.halo")
    # Of the copied rows the first by id comes first, null before all: for the last range that is the table's first row.
    w = Window.partitionBy("at").orderBy("halo", F.col("doc_id").asc_nulls_first(), "text")
    d = d.withColumn("next", F.lead("text").over(w)).withColumn("rn", F.row_number().over(w))
    n_chars, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n_chars - half), F.left(F.coalesce("next", F.lit("")), half))
    d = d.select("at", "rn", "doc_id", "halo", n_chars.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    d = d.withColumn("sha", F.when(~F.col("halo"), F.sha2("edited", 256)))
    # The digest travels through the aggregate as five numbers of 15 hex digits at most; text would force a sort.
    digest = [F.conv(F.substring("sha", 15 * i + 1, 15), 16, 10).cast("long").alias(f"h{i}") for i in range(5)]
    versions = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.when(F.col("halo"), F.lit("")).otherwise(F.col("edited")).alias("t")))
    rows = d.select("at", "rn", "doc_id", "halo", "n_chars", *digest, F.explode(versions).alias("x"))
    rows = with_words(rows.select("at", "rn", "doc_id", "halo", "n_chars", *[f"h{i}" for i in range(5)], "x.v", F.explode(paragraphs(F.col("x.t"))).alias("piece")))
    carried = [F.max(c).alias(c) for c in ("doc_id", "halo", "n_chars", *[f"h{i}" for i in range(5)])]
    sums = rows.groupBy("at", "rn", "v").agg(*carried, *lane_sums())
    exact, signed = lanes()
    sums = sums.select("at", "rn", "v", "doc_id", "halo", "n_chars", *[f"h{i}" for i in range(5)], exact.alias("exact"), signed.alias("signed"))
    sums = sums.withColumn("norm", _dot(F.col("signed"), F.col("signed")))
    sums = sums.withColumn("print", fingerprint_text(F.col("exact"), F.col("signed")))
    order = Window.partitionBy("at").orderBy("rn", "v")
    for name, ahead in (("edited", 1), ("next", 2)):
        for c in ("signed", "norm", "print"):
            sums = sums.withColumn(f"{name}_{c}", F.lead(c, ahead).over(order))
    like = lambda name: likeness(F.col("signed"), F.col(f"{name}_signed"), F.col("norm"), F.col(f"{name}_norm"), F.col("print") == F.col(f"{name}_print"))
    sha = F.concat(*[_hex(F.col(f"h{i}"), 15 if i < 4 else 4) for i in range(5)])
    return sums.where("v = 0 and not halo").select(
        "doc_id", "n_chars", sha.alias("edited_sha256"), F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"), like("edited").alias("near_edited"), like("next").alias("near_next"),
    )


def op2_multiset_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def _sql() -> str:
    word = lambda h, i: f"CAST('0x' || substr({h}, {8 * i + 1}, 8) AS BIGINT)"
    exact = ", ".join(f"CAST(sum({word('strong', i)}) % 4294967296 AS BIGINT)" for i in range(EXACT))
    bit = lambda j: f"(CAST('0x' || substr(weak, {15 * (j // 60) + 1}, 15) AS BIGINT) >> {j % 60}) & 1"
    signed = ", ".join(f"CAST(sum(CASE WHEN piece = chr(10) THEN 0 ELSE ({bit(j)}) * 2 - 1 END) AS BIGINT)" for j in range(SIGNED))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER w AS rn,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt, count(*) OVER () AS n
  FROM documents WINDOW w AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, left(text, CAST(length(text) - length(text) // 2 AS BIGINT)) || left(nxt, CAST(length(text) // 2 AS BIGINT)) AS edited FROM d),
x AS (SELECT rn, 0 AS v, text AS t FROM e UNION ALL SELECT rn, 1, edited FROM e),
p AS (
  SELECT rn, v, unnest(CASE WHEN t = '' THEN [''] ELSE regexp_extract_all(t, '[^.!?\\n]{{1,160}}[.!?]*|[.!?]+|\\n') END) AS piece FROM x),
h AS (SELECT *, sha256(piece) AS strong, md5(piece) AS weak FROM p),
s AS (SELECT rn, v, [{exact}] AS ex, [{signed}] AS si FROM h GROUP BY rn, v),
f AS (
  SELECT rn, v, list_transform(si, lambda x: (x + 32768) % 65536 - 32768 + CASE WHEN (x + 32768) % 65536 < 0 THEN 65536 ELSE 0 END) AS si,
         array_to_string(list_transform(ex, lambda x: printf('%08x', x)), '')
         || array_to_string(list_transform(si, lambda x: printf('%04x', (x % 65536 + 65536) % 65536)), '') AS fp FROM s),
j AS (
  SELECT e.doc_id, length(e.text) AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, c.fp AS next_fp,
         a.si AS sa, b.si AS sb, c.si AS sc
  FROM e JOIN f a ON a.rn = e.rn AND a.v = 0 JOIN f b ON b.rn = e.rn AND b.v = 1 JOIN f c ON c.rn = e.rn % e.n + 1 AND c.v = 0),
k AS (
  SELECT *, CAST(list_sum(list_transform(list_zip(sa, sa), lambda x: x[1] * x[2])) AS DOUBLE) AS aa,
         CAST(list_sum(list_transform(list_zip(sb, sb), lambda x: x[1] * x[2])) AS DOUBLE) AS bb,
         CAST(list_sum(list_transform(list_zip(sc, sc), lambda x: x[1] * x[2])) AS DOUBLE) AS cc,
         CAST(list_sum(list_transform(list_zip(sa, sb), lambda x: x[1] * x[2])) AS DOUBLE) AS ab,
         CAST(list_sum(list_transform(list_zip(sa, sc), lambda x: x[1] * x[2])) AS DOUBLE) AS ac FROM j)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE WHEN aa + bb = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2.0::DOUBLE * ab / (aa + bb))) END AS near_edited,
       CASE WHEN fingerprint = next_fp THEN 1.0::DOUBLE WHEN aa + cc = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2.0::DOUBLE * ac / (aa + cc))) END AS near_next
FROM k
"""


OP2_SQL = _sql()
