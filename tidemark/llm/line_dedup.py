"""Line deduplication that gives keep bitmaps, not texts.

Each line's key becomes a 128-bit hash, and its occurrences ``(hash, document, position)`` are
range-partitioned by hash and sorted by document and position within it. One pass over that order
numbers a key's documents as they stream by, marks the first occurrence, and knows at the group's
end whether the key is frequent. Only the positions of dropped lines go on to their documents, which
get a compressed bitmap of kept lines.

A key that would fill a range alone is cut by document into pieces first. Keys that frequent are few
by the arithmetic of a frequent-items sketch: at most ``HEAVY`` of them, whatever the table, so what
is known of them is joined back as a table of that bound. The sketch only decides which keys are cut;
documents are counted exactly for all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shield, stored

#: The six ASCII blanks, which are stripped from a line's ends.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys that are cut into pieces at most, counters of the sketch that finds them, and rows of a piece.
HEAVY, TRACKED, PIECE = 4096, 65536, 4096

_HASH, _DOC = ["_ld_a", "_ld_b"], ["_ld_doc", "_ld_text"]


def lines(text: Column) -> Column:
    """The lines of a text; null is one empty line, as the empty text is."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """What lines are compared by: no blanks at the ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with the id and the hash of the text that name a document; a null id is an id like others."""
    return docs.withColumns({"_ld_doc": F.col("doc_id").cast("long"), "_ld_text": F.xxhash64("text")})


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points or more."""
    key = F.col("key")
    found = docs.select(*_DOC, F.posexplode(lines(F.col("text"))).alias("pos", "line")).select(*_DOC, "pos", line_key(F.col("line")).alias("key"))
    return found.where(F.char_length(key) >= min_chars).select(F.xxhash64(key).alias("_ld_a"), F.xxhash64(F.lit(1), key).alias("_ld_b"), *_DOC, "pos")


def _heavy(rows: DataFrame, piece: int) -> DataFrame:
    """``(_ld_a, pieces)`` of first halves of hashes with more than ``piece`` rows, as far as they are among the ``HEAVY`` most frequent."""
    top = rows.agg(F.expr(f"approx_top_k(_ld_a, {HEAVY}, {TRACKED})").alias("top")).select(F.explode("top").alias("t"))
    return top.select(F.col("t.item").alias("_ld_a"), F.ceil(F.col("t.count") / piece).cast("int").alias("pieces")).where("pieces > 1")


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int, keep_first: bool, piece: int = PIECE) -> DataFrame:
    """``(_ld_doc, _ld_text, pos)`` of the lines that go."""
    rows = stored(occurrences(docs, min_chars), "lines")
    heavy = stored(_heavy(rows, piece), "heavy")
    cut = rows.join(F.broadcast(heavy), "_ld_a", "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*_DOC), F.col("pieces")).cast("int"))).drop("pieces")
    group = [*_HASH, "piece"]
    ranged = cut.repartitionByRange(*group)
    in_order = Window.partitionBy(*group).orderBy(*_DOC, "pos")
    # Documents are numbered by the order that the stream has, so the group's last number counts them.
    streamed = ranged.withColumns({"nth": F.dense_rank().over(Window.partitionBy(*group).orderBy(*_DOC)), "first": F.row_number().over(in_order) == 1})
    streamed = streamed.withColumn("docs", F.max("nth").over(Window.partitionBy(*group)))
    # What is settled within its range and stays is gone here; pieces of cut keys wait for their sum.
    open_ = stored(streamed.where((F.col("piece") > 0) | (F.col("docs") >= min_docs)).drop("nth"), "frequent")
    place = F.struct(*_DOC, "pos")
    piece_sums = open_.where("piece > 0 AND first").groupBy(*_HASH).agg(F.sum("docs").alias("total"), F.min(place).alias("foremost"))
    # Cut keys share at most HEAVY first halves of hashes, so this table has that bound too.
    whole = open_.join(F.broadcast(piece_sums), _HASH, "left")
    goes = F.col("piece").eqNullSafe(0) | (F.col("total") >= min_docs)
    stays = F.col("first") & (F.col("foremost").isNull() | place.eqNullSafe(F.col("foremost"))) if keep_first else F.lit(False)
    return whole.where(goes & ~stays).select(*_DOC, "pos")


def _runs(n: Column, gone: Column) -> Column:
    """Lengths of the alternating runs of kept and dropped lines, kept ones first, from the sorted positions of dropped lines."""
    at = lambda i: F.get(gone, i)
    begins = F.filter(gone, lambda x, i: (i == 0) | (at(i - 1) != x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (at(i + 1) != x + 1))
    before = F.concat(F.array(F.lit(-1)), ends)
    pairs = F.zip_with(begins, ends, lambda b, e: F.struct(b.alias("b"), e.alias("e")))
    runs = F.flatten(F.transform(pairs, lambda p, i: F.array(p["b"] - F.get(before, i) - 1, p["e"] - p["b"] + 1)))
    return F.concat(runs, F.array(n - F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(-1)) - 1))


def _bits(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda n, i: F.repeat(F.when(i % 2 == 0, "1").otherwise("0"), n)), "")


def compress(runs: Column) -> Column:
    """A keep bitmap as bytes: 00 and a bit a line from the left, or 01 and runs as big-endian 32-bit lengths, whichever is shorter."""
    each = F.array_join(F.transform(runs, lambda n: F.lpad(F.hex(n), 8, "0")), "")
    bytes_ = F.regexp_extract_all(F.rpad(_bits(runs), (F.ceil(_total(runs) / 8) * 8).cast("int"), "0"), F.lit("[01]{8}"), F.lit(0))
    plain = F.array_join(F.transform(bytes_, lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), "")
    return F.when(F.size(runs) * 4 <= F.ceil(_total(runs) / 8), F.unhex(F.concat(F.lit("01"), each))).otherwise(F.unhex(F.concat(F.lit("00"), plain)))


def _total(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda a, n: a + n)


def decompress(keep: Column, n_lines: Column) -> Column:
    """The bitmap as one string, a ``1`` for a kept line and a ``0`` for a dropped one."""
    digits = F.hex(F.substring(keep, 2, 2**31 - 1))
    runs = F.transform(F.regexp_extract_all(digits, F.lit(".{8}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    plain = F.array_join(F.transform(F.regexp_extract_all(digits, F.lit(".{2}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")
    return F.when(F.hex(F.substring(keep, 1, 1)) == "01", _bits(runs)).otherwise(F.substring(plain, F.lit(1), n_lines))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, piece: int = PIECE) -> DataFrame:
    """``(doc_id, text_hash, n_lines, n_dropped, keep)`` of every document: a compressed bitmap of the lines that stay.

    A key (:func:`line_key`) of ``min_chars`` code points or more that is in ``min_docs`` documents
    or more loses all its lines, or with ``keep_first`` all but the first by document and position.
    A document is an id (null is one too) with a text: rows that repeat both are one document, with
    one bitmap, and rows that share an id alone are several. Null and empty texts have one empty
    line, which stays unless ``min_chars`` is 0. Other columns are not read; an empty table gives no
    rows.
    """
    docs = _identified(docs.select("doc_id", "text"))
    same = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"g.{c}")) for c in _DOC])
    gone = dropped_lines(docs, min_docs, min_chars, keep_first, piece).groupBy(*_DOC).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    sizes = docs.select(*_DOC, F.size(lines(F.col("text"))).alias("n")).distinct()
    found = sizes.alias("d").join(gone.alias("g"), same, "left").select("d._ld_doc", "d._ld_text", "d.n", F.coalesce("g.gone", F.array().cast("array<int>")).alias("gone"))
    found = found.withColumn("runs", _runs(F.col("n"), F.col("gone")))
    return found.select(F.col("_ld_doc").alias("doc_id"), F.col("_ld_text").alias("text_hash"), F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), compress(F.col("runs")).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, out: str = "kept_text") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text of the lines that stay, joined by line feeds; columns of these names are replaced."""
    docs, back = shield(docs.drop("n_lines", "n_dropped", out), "_ld_")
    own = bitmaps.select(F.col("doc_id").alias("_ld_doc"), F.col("text_hash").alias("_ld_text"), "n_lines", "n_dropped", F.col("keep").alias("_ld_keep"))
    both = _identified(docs).alias("d").join(own.alias("b"), F.col("d._ld_doc").eqNullSafe(F.col("b._ld_doc")) & (F.col("d._ld_text") == F.col("b._ld_text")))
    bits = F.split(decompress(F.col("_ld_keep"), F.col("n_lines").cast("int")), "")
    text = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.filter(F.arrays_zip(lines(F.col("text")).alias("l"), bits.alias("b")), lambda x: x["b"] == "1")["l"], "\n"))
    return both.select(*(F.col(f"d.{c}") for c in docs.columns), "n_lines", "n_dropped", text.alias(out)).withColumnsRenamed(back)


def digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every row."""
    docs = docs.select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs))
    return kept.select(F.col("doc_id").cast("long"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
