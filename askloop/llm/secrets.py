"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every whole text is searched for candidates of four kinds: ``assign`` (a named value), ``access`` (an access key id), ``hex``
(a long hexadecimal run) and ``bare`` (a long run of key characters that stands alone). Places are code points, end exclusive;
within a kind matches are leftmost and do not overlap. The first three kinds are spans by themselves.

The value of each candidate is hashed, and the corpus says how many documents, repositories and owners hold it. A value that
``COPIED_OWNERS`` owners or more hold is a widely copied ``example``; any other is ``live`` if it looks so (``LIVE_CHARS`` or
more different characters, with a digit and a letter), else ``weak``. The method adds the bare candidates that are live, and
those whose value some document assigns to a name while fewer than ``COPIED_OWNERS`` owners hold it, unless a span of the
first three kinds already covers their start.

Values are counted in two steps (by value, owner and repository; then by value), so a value that fills a third of all rows is
combined before it is shuffled, and the join back leaves a frequent value to Spark's skew join. Only places, hashes and values
are shuffled to scan; texts stay where they are read.

Defined cases: a null or empty text has no spans; a null owner or repository counts as one of its own; rows without an id and
rows that share an id are kept apart by their text; a row repeated whole gets the same result each time and counts once. Other
columns are not read. A value may be as long as the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds in their order, and what each matches.
KINDS = ("assign", "access", "hex", "bare")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is too short matches nothing further along either, so the least length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BARE = r"[A-Za-z0-9+/_-]{20,}"
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, BARE)))
LEAST_VALUE = 6
COPIED_OWNERS = 3
LIVE_CHARS = 10
HIDDEN = "[SECRET]"


def _row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")))


def candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, row_key, kind, start, end, value, owner, repository): every match, once for each different row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in repository]
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _row_key("doc_id", "text").alias("row_key"),
        F.coalesce(F.col(owner).cast("string"), F.lit("\x00")).alias("owner"),
        F.concat_ws("\x01", *named).alias("repository"),
        text.alias("text"),
    )
    found = texts.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in PATTERNS.items()])
    found = found.filter(" OR ".join(f"size({k}) > 0" for k in KINDS))
    gaps = [
        F.when(F.size(k) > 0, F.transform(F.split("text", p, -1), lambda g: F.length(g))).alias("gaps")
        for k, p in PATTERNS.items()
    ]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found"), g) for k, g in zip(KINDS, gaps)])
    owned = ["doc_id", "row_key", "owner", "repository"]
    kinds = found.select(*owned, F.inline(each)).filter("size(found) > 0")
    pairs = F.arrays_zip(F.col("found"), F.slice("gaps", 1, F.size("found")).alias("gaps"))
    matches = kinds.select(*owned, "kind", F.posexplode(pairs).alias("place", "match"))
    once = matches.groupBy(*owned, "kind", "place").agg(F.first("match").alias("match"))
    ahead = Window.partitionBy("doc_id", "row_key", "owner", "repository", "kind").orderBy("place")
    size = F.length("match.found")
    end = F.sum(F.col("match.gaps") + size).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match.found", ASSIGN, 2)).otherwise(F.col("match.found"))
    placed = once.select(*owned, "kind", end.alias("end"), size.alias("size"), value.alias("value"))
    sound = (F.col("kind") != "assign") | (F.length("value") >= LEAST_VALUE)
    return placed.filter(sound).select(*owned, "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def frequency(found: DataFrame) -> DataFrame:
    """(hash, n_docs, n_repositories, n_owners, assigned) of every candidate value."""
    hashed = found.withColumn("hash", F.sha2(F.col("value").cast("binary"), 256))
    assigned = F.max((F.col("kind") != "bare").cast("int"))
    by_row = hashed.groupBy("hash", "owner", "repository", "doc_id", "row_key").agg(assigned.alias("assigned"))
    by_place = by_row.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n_docs"), F.max("assigned").alias("assigned"))
    by_owner = by_place.groupBy("hash", "owner").agg(
        F.sum("n_docs").alias("n_docs"), F.count("*").alias("n_repositories"), F.max("assigned").alias("assigned")
    )
    return by_owner.groupBy("hash").agg(
        F.sum("n_docs").alias("n_docs"),
        F.sum("n_repositories").alias("n_repositories"),
        F.count("*").alias("n_owners"),
        F.max("assigned").alias("assigned"),
    )


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, row_key, kind, start, end, class, n_docs, n_repositories, n_owners): every span of every row."""
    found = candidates(docs, owner, repository)
    counts = frequency(found)
    spans = found.withColumn("hash", F.sha2(F.col("value").cast("binary"), 256)).join(counts, "hash")
    characters = F.size(F.array_distinct(F.split("value", "")))
    looks_live = (characters >= LIVE_CHARS) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    copied = F.col("n_owners") >= COPIED_OWNERS
    spans = spans.withColumn("class", F.when(copied, "example").when(looks_live, "live").otherwise("weak"))
    ordered = Window.partitionBy("doc_id", "row_key", "owner", "repository").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max(F.when(F.col("kind") != "bare", F.col("end"))).over(ordered) > F.col("start"), F.lit(False))
    added = ((F.col("class") == "live") | ((F.col("assigned") == 1) & ~copied)) & ~F.col("covered")
    kept = spans.withColumn("covered", covered).filter((F.col("kind") != "bare") | added)
    return kept.select("doc_id", "row_key", "kind", "start", "end", "class", "n_docs", "n_repositories", "n_owners").distinct()


def _as_text(spans: Column) -> Column:
    """kind:start:end of (start, place of the kind, end) structs, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind_at"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_document(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row for each row of ``docs``: counts by kind and class, ``base`` and all ``spans`` as text."""
    at = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    spans = scan(docs, owner, repository).withColumn("span", F.struct("start", at.alias("kind_at"), "end", "class"))
    gathered = spans.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list("span")).alias("found"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row_key("doc_id", "text").alias("row_key"))
    mine = gathered.select(F.col("doc_id").alias("its_id"), F.col("row_key").alias("its_key"), "found")
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("row_key") == F.col("its_key"))
    found = F.coalesce(F.col("found"), F.array().cast("array<struct<start:bigint,kind_at:int,end:bigint,class:string>>"))
    joined = rows.join(mine, same, "left").select("doc_id", found.alias("found"))


    def count(name: str, field: str, value) -> Column:
        return F.size(F.filter("found", lambda s: s[field] == value)).cast("bigint").alias(f"n_{name}")

    return joined.select(
        "doc_id",
        *[count(kind, "kind_at", k) for k, kind in enumerate(KINDS)],
        *[count(name, "class", name) for name in ("live", "example", "weak")],
        _as_text(F.filter("found", lambda s: s["kind_at"] < 3)).alias("base"),
        _as_text(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``docs`` with every span that is no widely copied example replaced by ``HIDDEN``; n_chars, if there, follows."""
    spans = scan(docs, owner, repository).filter("class <> 'example'")
    row = Window.partitionBy("doc_id", "row_key").orderBy("start", "end")
    before = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = islands.groupBy("doc_id", "row_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gathered = cuts.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    mine = gathered.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "__cuts")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (_row_key("doc_id", "text") == F.col("__key"))
    joined = docs.join(mine, same, "left")
    cut, text = F.col("__cuts"), F.col("text")
    # Each island gives the text between it and the one before, then the mark.
    parts = F.transform(
        cut,
        lambda c, i: F.concat(
            F.substr(text, F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)).cast("int") + 1, (c["start"] - F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))).cast("int")),
            F.lit(HIDDEN),
        ),
    )
    rest = F.substr(text, F.element_at(cut, -1)["end"].cast("int") + 1)
    cleaned = F.when(cut.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))
    out = joined.withColumn("text", cleaned).drop("__id", "__key", "__cuts")
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
