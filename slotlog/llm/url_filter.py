"""URL filters (12): a rule list, and association rules mined from what it says.

A rule of the list is a host, a path prefix and a verdict; it fits its host and all subdomains, and of the rules that fit
the longest wins. URLs without such a rule are judged by association: Spark's FP-growth mines combinations of URL tokens that occur
often enough with a verdict in labelled URLs (for the query: those the list judges), rules below a confidence go, and so do rules that
a part of their own tokens makes with the same confidence. The rest stands in an inverted index under the rarest token of each
rule; a URL looks up its tokens and the best rule whose tokens it all has decides.

Tokens that occur in exactly the same labelled URLs are mined as one, and those in all of them not at all: combinations of
tokens that always come together would multiply without saying more.

Defined results: host and path of a null URL or of one without ``://`` are empty, it has no tokens and gets the default verdict; an empty
table gives no rows, without labelled URLs all get the default verdict; repeated rows and ids are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlog.session import cut_lineage

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOST, PATH, QUERY = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)", r"(?s)^.*?://[^?#]*\?([^#]*)"
DEFAULT = "allow"
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.01, 3, 0.8


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, CAPITALS, CAPITALS.lower())


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z in lower case) and path (up to ``?`` or ``#``)."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return lower_ascii(F.regexp_extract(url, HOST, 1)), F.regexp_extract(url, PATH, 1)


def fitting(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (size, host_size, verdict, rule), or null; rules are looked up by each suffix of the host."""
    if not rules:
        return F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string,path:string>")
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)

    def struct(r: Rule) -> Column:
        return F.struct(F.lit(len(r.text)).alias("size"), F.lit(len(r.host)).alias("host_size"), F.lit(r.verdict).alias("verdict"),
                        F.lit(r.text).alias("rule"), F.lit(r.path).alias("path"))

    known = F.create_map(*[x for h, own in by_host.items() for x in (F.lit(h), F.array(*[struct(r) for r in own]))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.filter(suffixes, lambda s: F.array_contains(F.array(*[F.lit(h) for h in by_host]), s))
    found = F.flatten(F.transform(F.array_distinct(suffixes), lambda s: F.element_at(known, s)))
    return F.when(host != "", F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"]))))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, its last label, segments of the path with digits as one sign, names in the query."""
    def some(parts: Column, sign: str) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(sign), p))

    query = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), QUERY, 1)
    segments = F.split(F.regexp_replace(lower_ascii(path), "[0-9]+", "0"), "/", -1)
    names = F.transform(F.split(query, "&", -1), lambda q: F.regexp_extract(q, "(?s)^([^=]*)", 1))
    labels = F.split(host, r"\.", -1)
    return F.array_sort(F.array_distinct(F.concat(some(labels, "h:"), some(F.slice(labels, -1, 1), "t:"), some(segments, "p:"), some(names, "q:"))))


def parsed(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, tokens and the rule list's ``rule`` and ``listed`` verdict (null where none fits)."""
    host, path = split_url(pages[url_col])
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    return rows.select("page_id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"),
                       F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("listed"))


RULES = "antecedent array<string>, verdict string, confidence double, support double, key string"


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from rows (tokens, verdict): antecedent, verdict, confidence, support and the key they are indexed under.

    A combination must occur with the verdict in ``min_support`` of the rows and in ``min_rows``.
    """
    spark = labelled.sparkSession
    rows = cut_lineage(labelled.select("tokens", "verdict").withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RULES)
    least = max(min_support, min_rows / n)
    held = rows.select("row", F.explode("tokens").alias("token"))
    # Which rows hold a token: their number and two sums of hashes, so tokens of the same rows are found without listing rows.
    mark = F.xxhash64("row")
    seen = held.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 30)).alias("y"))
    seen = seen.filter((F.col("size") < n) & (F.col("size") >= least * n))
    kept = cut_lineage(seen.groupBy("size", "x", "y").agg(F.min("token").alias("token")).select("token", "size"), "url-tokens")
    items = held.join(kept, "token").groupBy("row").agg(F.collect_set("token").alias("items"))
    none = F.array().cast("array<string>")
    items = rows.join(items, "row", "left").select(F.concat(F.coalesce("items", none), F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(cut_lineage(items, "url-items")).associationRules
    made = found.filter(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("=")))
    made = made.select(F.array_sort("antecedent").alias("antecedent"), F.expr("substring(element_at(consequent, 1), 2)").alias("verdict"), "confidence", "support")
    # The rarest token of a rule is its key.
    sizes = made.select("antecedent", F.explode("antecedent").alias("token")).distinct().join(kept, "token")
    keys = sizes.groupBy("antecedent").agg(F.min(F.struct("size", "token")).alias("k")).select("antecedent", F.col("k.token").alias("key"))
    made = cut_lineage(made.join(keys, "antecedent"), "url-rules")
    # A rule that a part of its tokens makes as surely is left out; the part is found under its own key.
    small = made.select("key", F.col("antecedent").alias("part"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    large = made.select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("key"))
    over = large.join(small, "key").filter((F.col("same") == F.col("verdict")) & (F.col("sure") >= F.col("confidence"))
                                           & (F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return cut_lineage(made.join(over.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti"), "url-rules")


def matched(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """row and verdict of the rows (row, tokens) that have all tokens of a rule: the surest, then most frequent, shortest, first in text."""
    looked = rows.select("row", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
    hits = looked.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    order = F.struct((-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), F.size("antecedent").alias("c"), F.col("antecedent").alias("d"), "verdict")
    return hits.groupBy("row").agg(F.min(order).alias("best")).select("row", F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT,
          min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``labelled`` (url, verdict) is what association rules are mined from; without it, the pages that ``rules`` judge.
    """
    rows = cut_lineage(parsed(pages, rules, id_col, url_col).withColumn("row", F.monotonically_increasing_id()), "url-pages")
    if labelled is None:
        known = rows.filter(F.col("listed").isNotNull()).select("tokens", F.col("listed").alias("verdict"))
    else:
        host, path = split_url(labelled["url"])
        known = labelled.select(tokens(labelled["url"], host, path).alias("tokens"), labelled["verdict"].cast("string").alias("verdict"))
        known = known.filter(F.col("verdict").isNotNull())
    found = matched(rows.filter(F.col("listed").isNull()), mine(known, min_support, min_rows, min_confidence))
    return rows.join(found, "row", "left").select("page_id", "host", "path", "rule", F.coalesce("listed", "verdict", F.lit(default)).alias("verdict"))


def oracle(rules: Sequence[Rule], default: str = DEFAULT) -> str:
    """The same verdicts in DuckDB: every combination of the frequent tokens of a URL is counted."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    low = f"'{CAPITALS}', '{CAPITALS.lower()}'"
    listed = ", ".join(f"({quoted(r.host)}, {quoted(r.path)}, {quoted(r.verdict)})" for r in rules)
    def some(e, sign):
        return f"list_transform(list_filter({e}, lambda p: p <> ''), lambda p: '{sign}' || p)"
    return f"""
  with recursive rules as (select * from (values {listed}) r(h, p, v)),
  cut as (select row_number() over () as id, page_id, translate(regexp_extract(u, '{HOST}', 1), {low}) as host, regexp_extract(u, '{PATH}', 1) as path,
          regexp_extract(u, '{QUERY}', 1) as query from (select page_id, coalesce(url, '') as u from pages) x),
  toks as (select *, list_sort(list_distinct(list_concat({some("string_split(host, '.')", 'h:')}, {some("[string_split(host, '.')[-1]]", 't:')},
           {some(f"string_split(regexp_replace(translate(path, {low}), '[0-9]+', '0', 'g'), '/')", 'p:')},
           {some("list_transform(string_split(query, '&'), lambda q: regexp_extract(q, '(?s)^([^=]*)', 1))", 'q:')}))) as tokens from cut),
  fits as (select id, arg_max(h || p, (length(h || p), length(h), v)) as rule, arg_max(v, (length(h || p), length(h), v)) as v
           from cut, rules where host <> '' and (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by id),
  known as (select t.id, tokens, v from toks t join fits using (id)),
  total as (select count(*) as n, ceil(greatest({MIN_SUPPORT}::double, {MIN_ROWS}::double / count(*)) * count(*)) as least from known),
  held as (select id, unnest(tokens) as token from known),
  seen as (select token, count(*) as size, list_sort(list(id)) as ids from held group by token),
  kept as (select min(token) as token from seen, total where size < n and size >= least group by ids),
  items as (select id, v, list_sort(list(token)) as items from held join kept using (token) join known using (id) group by id, v),
  kinds as (select items, v, count(*) as c from items group by items, v),
  sets as (select items, v, c, []::varchar[] as part, 0::bigint as i from kinds
           union all select items, v, c, list_append(part, items[j]), j from (select *, unnest(range(i + 1, len(items) + 1)) as j from sets) x),
  counts as (select part, v, sum(c) as c, sum(sum(c)) over (partition by part) as whole from sets where i > 0 group by part, v),
  made as (select part, v, c / whole::double as sure, c as support from counts, total where c >= least and c / whole::double >= {MIN_CONFIDENCE}::double),
  best as (select id, arg_min(made.v, (-sure, -support, len(part), part, made.v)) as v from toks, made
           where list_has_all(tokens, part) and id not in (select id from fits) group by id)
  select page_id, host, path, fits.rule as rule, coalesce(fits.v, best.v, '{default}') as verdict
  from toks left join fits using (id) left join best using (id)"""
