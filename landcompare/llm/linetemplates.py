"""Line dedup by a tree of log templates, in DataFrame operations only.

The tree has a fixed depth: a line's number of tokens, then its leading tokens. Tokens
with a digit are variable fields from the start. Within a leaf a token is constant if it
stands at its position in enough documents, else it is one more variable field. The
constants that are left are the line's template; one with enough constants that recurs
across documents is dropped from all of them but the first.

Documents with one text count once, whatever their number. A text is a copy of another one
if of the tokens of both, lines of five tokens and more, four fifths stand in lines that the
other is the first to hold, or more than half, in three lines or more that no third text
holds: those lines stay, for near-duplicate removal. Lines of other texts go from copies too.

Hot lines: documents are counted per line after a distinct over line and text, which
spreads a line that stands in a third of all rows over all tasks; only lines in leaves
that hold several are taken apart into tokens, each of them once.

Rows: null text stays null and counts as empty, null ids stay and come last where the
first occurrence is sought, repeated rows are treated alike, an empty table gives an
empty result. Other columns pass through whatever their names; ``n_chars``, if there, is
set anew. Lines end at line feeds; blank ones are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.llm.common import stored, table

MIN_DOCS = 2  # distinct texts in which a template recurs
MIN_TOKENS = 5  # shorter lines are never dropped
LEADING = 3
CONSTANT_SHARE = 0.8
COPY_SHARE, COPY_LINES, WHOLE_SHARE = 0.5, 3, 0.8
FIELD = "<*>"
BITMAPS, BITMAP_BITS = 2048, 1 << 15  # 8 MB, which tell some ten million keys from others


def masked(text: Column) -> Column:
    """The lines of a text, with single blanks between their tokens and those with a digit as a variable field.

    Both patterns run once over the whole text; each token is looked at once. Single blanks are no match, and all
    before the next digit is passed at once; the field put at the end is found from anywhere, so no search is in vain.
    """
    text = F.regexp_replace(text, r"[\x09\x0B-\x0D\x20](?:[\x09\x0B-\x0D\x20]++|(?<!\x20))", " ")
    text = F.regexp_replace(F.concat(text, F.lit(" 0")), r"((?:[^0-9]*[ \n])?)[^ \n0-9]*+[0-9][^ \n]*+", f"$1{FIELD}")
    # As the one entry of an array, so that it is computed once.
    text = F.transform(F.array(text), lambda whole: F.substring(whole, F.lit(1), F.length(whole) - len(FIELD) - 1))[0]
    return F.transform(F.split(text, "\n"), lambda line: F.trim(line))


def lines_of(docs: DataFrame, min_tokens: int) -> DataFrame:
    """(doc_id, digest, line, masked, n, leaf, exact, place): every line of at least ``min_tokens`` tokens."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # The generator keeps the lines from being computed anew in every column.
    rows = rows.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(masked(F.col("text"))).alias("line", "masked"))
    rows = rows.withColumn("n", F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "))) + 1).where(F.col("n") >= min_tokens)
    leaf = F.xxhash64("n", F.substring_index("masked", " ", LEADING))
    return rows.select("*", leaf.alias("leaf"), F.xxhash64("n", "masked").alias("exact"), F.xxhash64("doc_id", "digest", "line").alias("place"))


def sifted(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose column ``name``, evenly spread integers, may be among that of ``keys``, and few others, without a shuffle of the rows.

    The keys are marked in bitmaps of one size in all, which every task holds; those too many for them only let more other rows pass.
    """
    spot = lambda key: (key.bitwiseAND(F.lit(BITMAPS * BITMAP_BITS - 1)) + 1)  # noqa: E731  bitmaps count from 1
    marks = keys.select(F.bitmap_bucket_number(spot(F.col(name))).alias("bitmap"), F.bitmap_bit_position(spot(F.col(name))).alias("bit"))
    marks = marks.repartition("bitmap").groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bit = F.bitmap_bit_position(spot(rows[name]))
    octet = F.conv(F.hex(F.substring(marks["bits"], (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (F.bitmap_bucket_number(spot(rows[name])) == marks["bitmap"]) & (F.getbit(octet, (bit % 8).cast("int")) == 1)
    return rows.join(F.broadcast(marks), marked, "left_semi")


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, share: float = CONSTANT_SHARE) -> tuple[DataFrame, DataFrame]:
    """All lines (doc_id, digest, line, n, leaf, exact), and (leaf, exact, template) of those whose template recurs."""
    lines = lines_of(docs, min_tokens)
    fields = (F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(FIELD)))) / len(FIELD)
    # With the masked lines, which cost most of the time, in a column of their own that only the tokens below are taken from.
    held = stored(lines.select("doc_id", "digest", "line", "n", "leaf", "exact", "place", fields.cast("int").alias("fields"), "masked"), "line-keys", "zstd")
    keyed = held.drop("masked")
    # One row per line and text, then per line, each with one of its places.
    kinds = keyed.groupBy("leaf", "exact", "n", "fields", "digest").agg(F.min("place").alias("place"))
    kinds = kinds.groupBy("leaf", "exact", "n", "fields").agg(F.count("*").alias("texts"), F.min("place").alias("place"))
    kinds = stored(kinds.where(F.col("n") - F.col("fields") >= share * F.col("n")).drop("fields"), "line-kinds")
    # Leaves that hold several lines are taken apart into tokens, each line once, from one place.
    leaves = kinds.groupBy("leaf").agg(F.count("*").alias("lines")).where("lines > 1").select("leaf")
    wanted = stored(kinds.join(leaves, "leaf", "left_semi"), "line-wanted")
    once = sifted(held.select("place", "masked"), wanted, "place").join(wanted.hint("shuffle_hash"), "place").dropDuplicates(["place"])
    parts = once.select("leaf", "exact", "n", "texts", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    parts = parts.where(F.col("token") != FIELD).select("leaf", "exact", "n", "texts", F.xxhash64("at", "token").alias("token"), (F.col("at") < LEADING).alias("leads"))
    parts = stored(parts, "line-tokens")
    # A leading token is the same in all of a leaf; the others are counted.
    inner = parts.where("NOT leads")
    constants = inner.groupBy("leaf", "token").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= min_docs).select("leaf", "token")
    whole = inner.join(constants, ["leaf", "token"], "left_semi").unionByName(parts.where("leads"))
    general = whole.groupBy("leaf", "exact", "n").agg(F.bit_xor("token").alias("signature"), F.count("*").alias("constants"))
    general = general.where(F.col("constants") >= share * F.col("n")).select("leaf", "exact", F.xxhash64("leaf", "signature", "constants").alias("template"))
    general = stored(general, "line-templates")
    bearers = keyed.select("leaf", "exact", "digest").join(general, ["leaf", "exact"]).select("template", "digest").distinct()
    often = bearers.groupBy("template").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs).select("template")
    general = general.join(often, "template", "left_semi").select("leaf", "exact", "template")
    plain = kinds.where(F.col("texts") >= min_docs).select("leaf", "exact").join(general, ["leaf", "exact"], "left_anti")
    return keyed, general.unionByName(plain.withColumn("template", F.col("exact")))


def dropped(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, digest, drops ARRAY<INT>): the lines to drop of each row, by number from 0."""
    keyed, templates = recurring(docs, min_docs, min_tokens)
    found = stored(keyed.join(templates, ["leaf", "exact"]).select("doc_id", "digest", "line", "n", "template"), "line-recurring")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "line")
    bearers = stored(found.groupBy("template", "digest").agg(F.min(place).alias("first"), F.first("n").alias("n")), "line-bearers")
    firsts = bearers.groupBy("template").agg(F.min("first").alias("first"), F.count("*").alias("texts")).withColumn("holder", F.col("first.digest"))
    # Tokens of a text: its other lines, and each recurring template once. A text counts once, whatever its rows.
    others = keyed.select("digest", "line", "n").unionByName(found.select("digest", "line", F.lit(0).alias("n")))
    others = others.groupBy("digest", "line").agg(F.min("n").alias("n")).where("n > 0").groupBy("digest").agg(F.sum("n").alias("tokens"))
    own = others.unionByName(bearers.groupBy("digest").agg(F.sum("n").alias("tokens"))).groupBy("digest").agg(F.sum("tokens").alias("tokens"))
    # Copies, by text and the first holder of lines.
    pairs = bearers.select("template", "digest", "n").join(firsts.drop("first"), "template").groupBy("digest", "holder")
    pairs = pairs.agg(F.sum("n").alias("again"), F.count("*").alias("lines"), F.max("texts").alias("texts"))
    pairs = pairs.join(own, "digest").join(own.select(F.col("digest").alias("holder"), F.col("tokens").alias("held")), "holder")
    share = F.col("again") / (F.col("tokens") + F.col("held") - F.col("again"))
    copy = (share > COPY_SHARE) & (F.col("lines") >= COPY_LINES) & (F.col("texts") == 2) | (share >= WHOLE_SHARE)
    copies = pairs.where(copy).select("digest", "holder")
    later = found.withColumn("place", place).join(firsts, "template").where("place <> first")
    same = F.col("holder").eqNullSafe(F.col("digest")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))  # repeats within a row always go
    later = later.select("digest", "doc_id", "line", F.when(~same, F.col("holder")).alias("holder")).join(copies, ["digest", "holder"], "left_anti")
    id_ = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("some_id")
    return later.select("digest", *id_, "line").groupBy("digest", "no_id", "some_id").agg(F.sort_array(F.collect_set("line")).alias("drops"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, counts: bool = False) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; with ``counts`` also n_lines and n_dropped."""
    drops = dropped(docs, min_docs, min_tokens)
    rows = docs.select(F.struct("*").alias("row"))
    doc_id = F.col("row.doc_id").cast("bigint")
    rows = rows.select("row", F.xxhash64(F.col("row.text").cast("string")).alias("digest"), doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("some_id"))
    rows = rows.join(drops.hint("shuffle_hash"), ["digest", "no_id", "some_id"], "left")
    lines = F.split(F.col("row.text").cast("string"), "\n")
    kept = F.filter(lines, lambda _, k: ~F.array_contains(F.col("drops"), k))
    text = F.when(F.col("drops").isNull(), F.col("row.text").cast("string")).otherwise(F.array_join(kept, "\n"))
    fresh = {"text": F.col("new_text")} | ({"n_chars": F.coalesce(F.char_length("new_text"), F.lit(0)).cast("bigint")} if "n_chars" in docs.columns else {})
    rows = rows.withColumn("new_text", text)
    columns = [fresh[c].alias(c) if c in fresh else F.col("row").getField(c).alias(c) for c in docs.columns]
    more = [F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped")] if counts else []
    return rows.select(*columns, *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select("doc_id", "text", "n_lines", "n_dropped")
