"""URL filter: listed host and path rules, then association rules over URL tokens."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, written

#: Fixed values: (verdict, host, path) rules of the production list.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Rows hold addresses or token lists here: a table of more is joined by a shuffle instead of being broadcast.
BROADCAST_ROWS = 50_000
#: A token combination on fewer labelled pages gives no rule, however many pages there are.
MIN_PAGES = 20
#: A rule says block or allow if so large a share of the labelled pages that it fits say so.
MIN_CONFIDENCE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does.

    A rule fits its host and all subdomains when the path starts with its path. Length is the
    host's labels, then the path's characters.
    """
    longest_first = sorted(rules, key=lambda r: (-r[1].count("."), -len(r[1]), -len(r[2])))

    def fits(r) -> Column:
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in longest_first])


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels (``h:``) and pieces of the path between non-alphanumerics (``p:``)."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.when(x != "", F.concat(F.lit("h:"), x)))
    pieces = F.transform(F.split(path, r"[^\p{L}\p{N}]+"), lambda x: F.when(x != "", F.concat(F.lit("p:"), x)))
    return F.array_distinct(F.array_compact(F.concat(labels, pieces)))


def common_items(words: DataFrame, min_pages: int) -> DataFrame:
    """token, item, freq: the tokens of words(row, token) on min_pages rows at least; those on the very same rows are one item, named by the least.

    A long path that many addresses repeat is one item so, instead of all combinations of its pieces.
    """
    same = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"rows{k}") for k in (1, 2)]
    seen = words.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), *same).where(F.col("freq") >= min_pages)
    item = F.min("token").over(Window.partitionBy("freq", "rows1", "rows2"))  # distinct tokens of the same rows
    return seen.select("token", item.alias("item"), "freq")


def mine_rules(labelled: DataFrame, *, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, max_items: int | None = None, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Token combinations of labelled(tokens, blocked) that foretell a verdict, and the items they are made of.

    rule_id, items, anchor, verdict, confidence, pages; token, item: any token of an item stands for it
    (``common_items``). Spark's FP-growth finds the combinations on min_pages rows at least, with the
    label as one more item; rules under min_confidence go. anchor is the rule's rarest item, under which
    the inverted index keeps it. All items of a row are combined, unless max_items names how many, the
    rarest first: combinations grow with two to the power of a row's common items. No labelled row gives
    no rule.
    """
    spark = labelled.sparkSession
    rows = written(labelled.where("blocked is not null").select("tokens", "blocked").withColumn("row", F.monotonically_increasing_id()), "labelled")
    words = rows.select("row", F.explode("tokens").alias("token"))
    items = written(common_items(words, min_pages), "items")
    own = F.array_sort(F.collect_set(F.struct("freq", "item")))
    kept = words.join(broadcast_if_small(items, broadcast_rows), "token").groupBy("row").agg((own if max_items is None else F.slice(own, 1, max_items)).alias("t"))
    label = F.when(F.col("blocked"), "label:block").otherwise("label:allow")
    baskets = rows.join(kept, "row", "left").select(F.array_append(F.coalesce(F.transform("t", lambda x: x["item"]), F.array().cast("array<string>")), label).alias("items"))
    baskets = written(baskets, "baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], "rule_id long, items array<string>, anchor string, verdict string, confidence double, pages long"), items.select("token", "item")
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, min(1.0, (min_pages - 0.5) / n)), minConfidence=min_confidence).fit(baskets)
    said = F.get("consequent", F.lit(0))
    found = model.associationRules.where(said.startswith("label:") & ~F.exists("antecedent", lambda t: t.startswith("label:")))
    pages = F.round(F.col("support") * n / F.col("confidence")).cast("long")  # that the items fit
    rules = found.select(F.array_sort("antecedent").alias("items"), F.substring(said, 7, 5).alias("verdict"), "confidence", pages.alias("pages"))
    rules = written(rules.withColumn("rule_id", F.xxhash64("items", "verdict")), "mined")
    weight = items.select("item", "freq").distinct()
    rarest = rules.select("rule_id", F.explode("items").alias("item")).join(weight, "item").groupBy("rule_id").agg(F.min_by("item", F.struct("freq", "item")).alias("anchor"))
    return rules.join(rarest, "rule_id").select("rule_id", "items", "anchor", "verdict", "confidence", "pages"), items.select("token", "item")


def is_held_out(host: Column, path: Column) -> Column:
    """A fifth of the addresses, by hash: no rule is mined from them."""
    return F.pmod(F.xxhash64(host, path, F.lit(5)), F.lit(5)) == 0


def listed_pages(pages: DataFrame, rules) -> DataFrame:
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    return written(parts.select("page_id", "url", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict")), "parts")


def rule_hits(urls: DataFrame, index: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame:
    """host, path, said, confidence of the distinct urls(host, path) that a rule of the written index fits.

    The surest rule decides; of equal ones that of most pages, then of fewest items, then to block.
    """
    order = F.struct("confidence", "pages", (-F.size("items")).alias("fewest"), "verdict", F.array_join("items", " ").alias("name"))
    side = broadcast_if_small(index.select("anchor", F.col("items").alias("needed"), order.alias("rule")), broadcast_rows)
    tokens = urls.select("host", "path").distinct().select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    own = tokens.join(broadcast_if_small(items, broadcast_rows), "token").groupBy("host", "path").agg(F.collect_set("item").alias("own"))
    probes = own.select("host", "path", "own", F.explode("own").alias("anchor"))
    hits = probes.join(side, "anchor").where(F.size(F.array_except("needed", "own")) == 0)
    best = hits.groupBy("host", "path").agg(F.max("rule").alias("rule"))
    return written(best.select("host", "path", F.col("rule.verdict").alias("said"), F.col("rule.confidence").alias("confidence")), "hits")


def list_labels(parts: DataFrame) -> DataFrame:
    """host, path, blocked of the pages that the list decides."""
    return parts.where("verdict is not null").select("host", "path", (F.col("verdict") == "block").alias("blocked"))


def split_labels(labels: DataFrame) -> DataFrame:
    """host, path, blocked of labels(url, blocked)."""
    return labels.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), F.col("blocked").cast("boolean").alias("blocked"))


def _index(labelled: DataFrame, how: dict) -> tuple[DataFrame, DataFrame]:
    """The rules, and their items, mined from the labelled addresses that aren't held out."""
    own = labelled.where(~is_held_out(F.col("host"), F.col("path")))
    rules, items = mine_rules(own.select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), "blocked"), **how)
    return written(rules, "index"), written(items, "index-items")


def rule_effect(pages: DataFrame, *, labels: DataFrame | None = None, rules=RULES, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """kind, pages, blocked, allowed: what the mined rules say of open pages and of held out addresses, by their labels."""
    parts = listed_pages(pages, rules)
    labelled = list_labels(parts) if labels is None else split_labels(labels)
    index, items = _index(labelled, {"broadcast_rows": broadcast_rows, **how})
    held = labelled.where(is_held_out(F.col("host"), F.col("path")) & F.col("blocked").isNotNull())
    kind = F.when(F.col("blocked"), "held out, to block").otherwise("held out, to allow")
    judged = parts.where("verdict is null").select("host", "path", F.lit("open").alias("kind")).unionByName(held.select("host", "path", kind.alias("kind")))
    judged = written(judged, "judged")
    hits = broadcast_if_small(rule_hits(judged, index, items, broadcast_rows), broadcast_rows)
    out = judged.join(hits, ["host", "path"], "left").groupBy("kind")
    return out.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("said") == "block").alias("blocked"), F.count_if(F.col("said") == "allow").alias("allowed"))


def url_verdicts(pages: DataFrame, *, rules=RULES, labels: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """A row for each row of pages(page_id, url): page_id, host, path, rule, verdict, said, confidence.

    Listed rules decide first. Association rules decide the rest: they are mined from labels(url,
    blocked), where a null says nothing, by default from the pages that the list decides, apart from a
    fifth of the addresses that is held out for rule_effect. Of the rules that fit, the surest says
    block or allow; an address that none fits is allowed. said and confidence are the mined rule's.
    A null address, or one without ``://``, has an empty host and path and is allowed. A very long one
    is read whole, and all its common tokens are combined. Repeated rows get the same verdict; an empty table gives an empty table. Other columns are ignored.

    Only distinct undecided addresses are exploded into tokens and joined with the index.
    """
    parts = listed_pages(pages, rules)
    index, items = _index(list_labels(parts) if labels is None else split_labels(labels), {"broadcast_rows": broadcast_rows, **how})
    hits = rule_hits(parts.where("verdict is null and host != ''"), index, items, broadcast_rows)
    out = parts.join(broadcast_if_small(hits, broadcast_rows), ["host", "path"], "left")
    own = F.col("rule").isNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "said", F.lit("allow")).alias("verdict"), F.when(own, F.col("said")).alias("said"), F.when(own, F.col("confidence")).alias("confidence"))
