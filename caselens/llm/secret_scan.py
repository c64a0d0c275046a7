"""Secret scans with corpus-wide ownership, in DataFrame operations alone.

Base kinds are patterns. A further kind, `key`, is any long mixed run of key characters; such
a run alone proves nothing, so its value is looked up over the whole corpus: values that many
owners or repositories hold are copied examples, and only values of few owners are reported.
Every reported span, base ones too, carries its value's owners and that verdict.

Where text stands comes from two passes of a pattern that agree: what it matches, and what
lies between. Only texts in which the pattern occurs pay for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.llm.common import ready, table_columns
from caselens.session import stored

#: Kinds, in the order in which they are listed, and their patterns. Fixed values.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "key": r"[A-Za-z0-9+/_=-]{20,}",
}
BASE = ("assign", "access", "hex")
LEAST_ASSIGNED = 12

#: A value held by more owners, or more repositories, than these is a copied example.
MOST_OWNERS = 3
MOST_REPOSITORIES = 6
#: Parts that the candidates of one value are dealt into.
SALTS = 16

SPAN = "array<struct<start:int,kind:int,end:int,value:bigint>>"


def _kept(kind: str, match: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 1)) >= LEAST_ASSIGNED
    if kind == "key":
        return match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    return F.xxhash64(F.regexp_extract(match, ASSIGN, 1) if kind == "assign" else match)


def _placed(kind: str, n: int) -> Column:
    """The kept spans of a kind from its hits and the gaps between them."""
    c = f"_{kind}"
    sized = F.expr(f"transform({c}.hits, (x, i) -> struct(x as hit, length(get({c}.gaps, i)) as gap, length(x) as size))")
    placed = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,hit:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(n).alias("kind"), (a["at"] + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.transform(F.filter(placed, lambda s: _kept(kind, s["hit"])), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _value(kind, s["hit"]).alias("value")))


def found_spans(docs: DataFrame, text: str) -> DataFrame:
    """docs with `spans`: (start, kind, end, value) in code points, end exclusive, by start
    and then kind; value is a hash of the secret. A `key` span overlaps no base span."""
    t = docs
    for kind, pattern in PATTERNS.items():
        has = F.col(text).rlike(pattern)
        t = t.withColumn(f"_{kind}", F.when(has, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))))
    for n, kind in enumerate(PATTERNS):
        t = t.withColumn(f"_{kind}", F.when(F.col(f"_{kind}").isNotNull(), _placed(kind, n)).otherwise(F.array().cast(SPAN)))
    t = t.withColumn("_base", F.concat(*(F.col(f"_{k}") for k in BASE)))
    free = F.filter("_key", lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return t.withColumn("spans", F.sort_array(F.concat("_base", free))).drop("_base", *(f"_{k}" for k in PATTERNS))


def _repository(owner: Column) -> Column:
    return F.concat_ws("/", owner, F.col("lang"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str | Column = "source", repository: str | Column | None = None) -> DataFrame:
    """(key, spans): spans are (start, end, kind, value, owners, repositories, live), by start
    and then kind.

    owners, repositories: how many of each hold the value in the whole corpus; live: no more
    than MOST_OWNERS and MOST_REPOSITORIES. Base kinds are reported either way, `key` spans
    only when live. A null text has no spans; a null owner counts as one owner; repeated rows
    come back each, null keys too; an empty table gives no rows. A repository is by default
    the owner and language of a document.
    """
    ready(docs.sparkSession)
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = _repository(owner) if repository is None else F.col(repository) if isinstance(repository, str) else repository
    slim = table_columns(docs, {"key": F.col(key), "text": F.coalesce(F.col(text), F.lit("")), "owner": F.coalesce(owner.cast("string"), F.lit("")), "repository": F.coalesce(repository.cast("string"), F.lit(""))})
    found = stored(found_spans(slim, "text").drop("text").withColumn("row_no", F.monotonically_increasing_id()), "spans")
    both = found.join(_ownership(found), "row_no", "left")
    return both.select(F.col("key").alias(key), _reported().alias("spans"))


def _ownership(found: DataFrame) -> DataFrame:
    """(row_no, held): the owners and repositories of each value among a row's candidates.
    Counts go by value, owner and repository first, so that a value meets its candidates, in
    parts, as one row for each part."""
    each = found.filter(F.size("spans") > 0).select("row_no", "owner", "repository", F.explode(F.array_distinct(F.transform("spans", lambda s: s["value"]))).alias("value"))
    known = each.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    known = known.select(F.col("value").alias("of"), "owners", "repositories", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = each.select("row_no", "value", F.pmod("row_no", F.lit(SALTS)).cast("int").alias("salt"))
    joined = dealt.join(known, (dealt["value"] == known["of"]) & (dealt["salt"] == known["part"]))
    return joined.groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("owners", "repositories")))).alias("held"))  # a text's own candidates


def _reported() -> Column:
    def marked(s: Column) -> Column:
        of = F.try_element_at("held", s["value"])
        live = (of["owners"] <= MOST_OWNERS) & (of["repositories"] <= MOST_REPOSITORIES)
        return F.struct(s["start"], s["end"], s["kind"], s["value"], of["owners"].alias("owners"), of["repositories"].alias("repositories"), live.alias("live"))

    return F.filter(F.transform("spans", marked), lambda s: s["live"] | (s["kind"] < len(BASE)))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", example: str = "[example]") -> DataFrame:
    """docs with every reported span of `text` replaced, n_chars to match: by mark where its
    value is live, by example where it is widely copied.

    Spans that touch or overlap become one mark, of the kind of their first. Texts without
    spans stay as they are, null and empty ones too; repeated rows and rows with a null
    doc_id stay each; an empty table stays empty; other columns come through.
    """
    ready(docs.sparkSession)
    owner = F.coalesce(F.col("source").cast("string"), F.lit(""))
    t = docs.select(F.struct("*").alias("row"), owner.alias("owner"), F.coalesce(_repository(owner), F.lit("")).alias("repository"), F.monotonically_increasing_id().alias("row_no"))
    t = stored(found_spans(t.withColumn("text", F.coalesce("row.text", F.lit(""))), "text").drop("text"), "spans")
    clean, hit = t.filter(F.size("spans") == 0), t.filter(F.size("spans") > 0)  # texts without spans go nowhere
    hit = hit.join(_ownership(t.drop("row")), "row_no", "left").withColumn("text", F.coalesce("row.text", F.lit("")))
    built = F.aggregate(
        _reported(),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when((s["start"] <= a["at"]) & (a["at"] > 0), a["out"]).otherwise(F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.when(s["live"], mark).otherwise(example))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))),
    )
    hit = hit.select("row", F.when(F.size(_reported()) > 0, built).alias("changed"))
    t = hit.unionByName(clean.select("row", F.lit(None).cast("string").alias("changed")))
    new = {"text": F.coalesce("changed", "row.text"), "n_chars": F.when(F.col("changed").isNull(), F.col("row.n_chars")).otherwise(F.length("changed").cast("long"))}
    return t.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    t = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = {n}))").cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    verdicts = [F.expr(f"size(filter(spans, s -> {c}))").cast("long").alias(f"n_{name}") for name, c in (("live", "s.live"), ("copied", "not s.live"))]
    owners = F.array_join(F.transform("spans", lambda s: s["owners"].cast("string")), ",")
    return t.select("doc_id", *counts, F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), *verdicts, owners.alias("owners"))


def _sql_spans(kind: str, n: int) -> str:
    pattern = PATTERNS[kind].replace("'", "''")
    return f"""
spans_{kind} AS (
  SELECT doc_id, text, source, lang, unnest(range(1, len(hits) + 1)) AS i, {n} AS kind, hits, gaps FROM (
    SELECT doc_id, text, source, lang, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM texts)),
placed_{kind} AS (
  SELECT doc_id, source, lang, kind, hits[i] AS hit,
         (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::INTEGER AS start
  FROM spans_{kind})"""


OP9_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents),
{','.join(_sql_spans(k, n) for n, k in enumerate(PATTERNS))},
candidates AS (
  SELECT *, start + length(hit) AS stop, CASE kind WHEN 0 THEN regexp_extract(hit, '{ASSIGN.replace("'", "''")}', 1) ELSE hit END AS value
  FROM ({' UNION ALL '.join(f'SELECT * FROM placed_{k}' for k in PATTERNS)})),
kept AS (
  SELECT * FROM candidates
  WHERE kind IN (1, 2) OR (kind = 0 AND length(value) >= {LEAST_ASSIGNED})
     OR (kind = 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]'))),
free AS (
  SELECT k.* FROM kept k WHERE kind < 3 OR NOT EXISTS (
    SELECT 1 FROM kept b WHERE b.kind < 3 AND b.doc_id = k.doc_id AND b.start < k.stop AND k.start < b.stop)),
held AS (
  SELECT value, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT concat_ws('/', coalesce(source, ''), lang)) AS repositories FROM free GROUP BY value),
judged AS (
  SELECT f.*, owners, owners <= {MOST_OWNERS} AND repositories <= {MOST_REPOSITORIES} AS live FROM free f JOIN held h ON f.value = h.value),
reported AS (SELECT * FROM judged WHERE kind < 3 OR live),
named AS (
  SELECT *, ['assign', 'access', 'hex', 'key'][kind + 1] || ':' || start || ':' || stop AS name FROM reported)
SELECT d.doc_id, count(*) FILTER (kind = 0)::BIGINT AS n_assign, count(*) FILTER (kind = 1)::BIGINT AS n_access,
       count(*) FILTER (kind = 2)::BIGINT AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY start, kind), '') AS spans,
       count(*) FILTER (live)::BIGINT AS n_live, count(*) FILTER (NOT live)::BIGINT AS n_copied,
       coalesce(string_agg(owners::VARCHAR, ',' ORDER BY start, kind), '') AS owners
FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id GROUP BY d.doc_id
"""
