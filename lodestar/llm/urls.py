"""URL filters by association rules, with DataFrame functions alone.

FP-growth mines combinations of url tokens (domain suffixes, path segments, names of query fields) that go with bad pages. A page's label is
the verdict of the hand-written rule that fits its url (block: bad, allow: good); if none does, the row of `labels` with its id
(quality 0 or toxic: bad); pages with neither aren't learned from. Rules are kept if they have the support, a confidence of over one
half, a lift over the share of bad pages, and so many bad pages that chance would not give them (a bound of `sigmas` standard errors), unless a
rule of fewer tokens has at least their confidence. They are matched by an inverted index from tokens to rules, which travels as a
literal: support bounds the rules, so their number doesn't grow with the pages. Hand-written rules go first: the longest
that fits decides.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end. Null urls, and those
without "://", have an empty host and path and no tokens, so no rule fits: allowed. Rows that repeat an id count separately; other
columns are ignored. Without labels and pages that hand-written rules fit nothing is mined.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule): a rule is a host, which fits itself and its subdomains, and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url."""
    host, path = parts(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(3))), lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -n, n), ".")))
    suffixes = F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>"))
    first = F.when(F.size(labels) > 2, F.array(F.concat(F.lit("s:"), F.element_at(labels, 1)))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("p:"), F.translate(x, _UPPER, _LOWER)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_distinct(F.concat(suffixes, first, segments, names))


def ruled(url: Column, fixed=RULES) -> tuple[Column, Column]:
    """The hand-written rule that decides a url, and its verdict; nulls if none fits."""
    host, path = parts(url)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(fixed, key=lambda r: len(r[1])):  # a longer one overrides
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def mine(pages: DataFrame, labels: DataFrame, fixed=RULES, support: float = 0.001, confidence: float = 0.5, lift: float = 1.2, sigmas: float = 4.0, least: int = 20, url_col: str = "url", id_col: str = "page_id", label_id: str = "doc_id") -> list[tuple[tuple[str, ...], float]]:
    """(tokens, confidence) of the rules for bad pages, pruned (see above).

    Rules hold in `support` of the pages learned from and in `least` bad ones, so there are at most (combinations of a url's
    tokens) / support of them, whatever the number of pages.
    """
    bad = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("__id")).agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    rows = pages.select(F.col(id_col).alias("__page"), url_tokens(F.col(url_col)).alias("t"), (ruled(F.col(url_col), fixed)[1] == "block").cast("int").alias("fixed"))
    rows = rows.join(bad, F.col("__page") == F.col("__id"), "left").select("t", F.coalesce("fixed", "bad").alias("bad")).where("bad is not null")
    baskets = rows.select(F.when(F.col("bad") == 1, F.array_append("t", F.lit(BAD))).otherwise(F.col("t")).alias("items")).where(F.size("items") > 0)
    n, base = baskets.agg(F.count(F.lit(1)), F.avg(F.array_contains("items", BAD).cast("int"))).first()
    if not n or not base:
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(baskets)
    with_ = F.col("support") * n / F.col("confidence")  # pages that hold the tokens
    sure = (F.col("lift") >= lift) & (F.col("confidence") - base >= sigmas * F.sqrt(base * (1 - base) / with_))
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD) & sure).select("antecedent", "confidence").collect()
    kept: dict[tuple[str, ...], float] = {}
    for tokens, conf in sorted(((tuple(sorted(r["antecedent"])), r["confidence"]) for r in found), key=lambda r: (len(r[0]), r[0])):
        if not any(kept.get(t, 0) >= conf for k in range(1, len(tokens)) for t in combinations(tokens, k)):
            kept[tokens] = conf
    return list(kept.items())


def matches(tokens: Column, rules: list[tuple[tuple[str, ...], float]]) -> Column:
    """Whether a rule's tokens are all there, by the inverted index."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[int]] = {}
    for i, (t, _) in enumerate(rules):
        for x in t:
            index.setdefault(x, []).append(i)
    lit = F.create_map(*(c for k, v in sorted(index.items()) for c in (F.lit(k), F.array(*map(F.lit, v)))))
    need = F.array(*(F.lit(len(t)) for t, _ in rules))
    hits = F.flatten(F.transform(F.filter(tokens, lambda t: t.isin(*index)), lambda t: F.element_at(lit, t)))
    return F.exists(F.array_distinct(hits), lambda r: F.size(F.filter(hits, lambda x: x == r)) == F.element_at(need, r + 1))


def judge(pages: DataFrame, rules: list[tuple[tuple[str, ...], float]], fixed=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule (the fixed rule that decided, or null), verdict, mined (whether a mined rule matches)."""
    host, path = parts(F.col(url_col))
    rule, verdict = ruled(F.col(url_col), fixed)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("v"), matches(url_tokens(F.col(url_col)), rules).alias("mined"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
