"""URL filters from association rules.

Labelled urls become baskets of tokens (host suffixes, words of hyphenated host labels,
path words, query keys).  FP-growth mines the token combinations that occur often enough among
them together with the label "bad"; combinations whose rule "tokens => bad" has enough
confidence and lift are kept, unless a shorter one already says as much.  A url is
blocked if all tokens of some rule are among its own, which an inverted index finds: a
rule is listed under its rarest token, and urls with that token are held against the rest.

FP-growth lists every subset of what urls share, so a basket of many frequent tokens would
cost without bound.  Tokens too rare for any rule go first.  Baskets that still hold more than
ITEMS are dealt into small ones that hold each three of their tokens together; these
find combinations of up to LENGTH tokens, which are then counted on the whole baskets.

Explicit rules (a host with its subdomains, and a path prefix) come first; the longest
that fits decides.  Everything is DataFrame expressions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import checkpointed

#: (host, path prefix, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Share of labelled urls that a rule covers and the least number of them, the share of those that are bad,
#: and how many times the overall share that is.  A rule that few urls bear out would only repeat their noise.
SUPPORT, COVERED, CONFIDENCE, LIFT = 0.002, 20, 0.6, 1.5
#: Longest combination mined, and about the most labelled urls that the miner fits to.
LENGTH, SAMPLE = 3, 500_000
#: Most tokens of a basket that FP-growth gets, and tokens in each of the three groups that a dealt basket is made of.
ITEMS, GROUP = 12, 2
#: Up to so many rules are sent along to every executor; more are joined by shuffle.
SENT = 100_000
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z in lower case; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest explicit rule that fits, as host and path together; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        name, verdict = F.when(fits, rule_host + prefix).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    """The different tokens of a url, as an array; empty for null."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(4))), lambda k: F.concat(F.lit("suffix:"), F.array_join(F.slice(labels, n - k + 1, k), "."))
    )
    tag = lambda name, words: F.transform(words, lambda w: F.concat(F.lit(f"{name}:"), w))
    filled = lambda words: F.filter(words, lambda w: F.length(w) > 0)
    # words of hyphenated labels; a whole label shows in the suffixes
    host_words = tag("host", F.flatten(F.transform(F.filter(labels, lambda w: F.contains(w, F.lit("-"))), lambda w: filled(F.split(w, "-")))))
    # a number in a path names a page, not a kind of page
    path_words = tag("path", filled(F.split(F.regexp_replace(F.lower(path), r"\d+", "0"), r"[/.\-_]")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = tag("query", filled(F.transform(F.split(query, "&"), lambda part: F.lower(F.regexp_extract(part, r"^([^=]*)", 1)))))
    every = F.concat(suffixes, host_words, path_words, keys)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine(
    labelled: DataFrame,
    url_col: str = "url",
    bad_col: str = "bad",
    support: float = SUPPORT,
    covered: int = COVERED,
    confidence: float = CONFIDENCE,
    lift: float = LIFT,
    length: int = LENGTH,
    sample: int = SAMPLE,
) -> DataFrame:
    """``(rule, tokens, confidence, covered, key)``: the pruned rules "tokens => bad" of labelled urls.

    ``rule`` is a hash of the tokens, ``key`` the rarest of them.  Beyond ``sample`` labelled urls the miner fits
    to about as many of them, chosen by a hash of the url.
    """
    if length > 3:
        raise ValueError("dealt baskets hold three tokens together at most")
    spark = labelled.sparkSession
    schema = "rule long, tokens array<string>, confidence double, covered long, key string"
    known = labelled.where(F.col(bad_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(bad_col).cast("boolean").alias("bad"))
    share = min(1.0, sample / max(1, known.count()))
    place = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / float(1 << 30)
    baskets = checkpointed(known.where(place < share).select("bad", tokens(F.col("url")).alias("items")))
    n, bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return spark.createDataFrame([], schema)
    least = max(covered, support * n)
    # a token of a rule occurs `least` times, and so often that the rule can be sure enough; at most size / support tokens do
    common = baskets.select("bad", F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.count_if("bad").alias("hits"))
    common = checkpointed(common.where((F.col("freq") >= least) & (F.col("hits") >= least * confidence)))
    rows = baskets.select(F.monotonically_increasing_id().alias("row"), "bad", "items")
    pruned = rows.select("row", "bad", F.explode("items").alias("token")).join(F.broadcast(common), "token")
    pruned = checkpointed(pruned.groupBy("row").agg(F.any_value("bad").alias("bad"), F.sort_array(F.collect_list("token")).alias("items")).drop("row"))
    wide = not pruned.where(F.size("items") > ITEMS).isEmpty()
    fed = checkpointed(pruned.select("bad", F.explode(_dealt(F.col("items"))).alias("items"))) if wide else pruned
    fed = fed.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    baskets_fed = fed.count()
    if not baskets_fed:
        return spark.createDataFrame([], schema)
    frequent = FPGrowth(minSupport=max(0.0, least * confidence - 0.5) / baskets_fed, minConfidence=1.0).fit(fed).freqItemsets
    key = F.array_sort(F.array_except("items", F.array(F.lit(BAD))))
    sets = frequent.select(key.alias("tokens"), F.array_contains("items", BAD).alias("bad"), "freq").where(F.size("tokens").between(1, length))
    counted = sets.groupBy("tokens").agg(F.max(F.when(~F.col("bad"), F.col("freq"))).alias("covered"), F.max(F.when(F.col("bad"), F.col("freq"))).alias("hits"))
    counted = _keyed(counted.where("hits IS NOT NULL AND covered IS NOT NULL"), common)
    if wide:
        found = pruned.select("bad", "items", F.explode("items").alias("key")).join(counted.select("key", "tokens"), "key")
        found = found.where(F.size(F.array_except("tokens", "items")) == 0)
        counted = found.groupBy("tokens", "key").agg(F.count("*").alias("covered"), F.count_if("bad").alias("hits"))
    rules = checkpointed(
        counted.withColumn("confidence", F.col("hits") / F.col("covered")).where(
            (F.col("covered") >= least) & (F.col("confidence") >= confidence) & (F.col("confidence") >= lift * bad / n)
        )
    )
    # a rule is idle where a shorter one inside it is at least as sure: join each rule to its own shorter parts
    parts = rules.select("tokens", "confidence", F.explode(_parts(F.col("tokens"))).alias("part"))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    idle = parts.join(shorter, "part").where("sure >= confidence").select("tokens").distinct()
    kept = rules.join(idle, "tokens", "left_anti")
    # numbered by their content, so that no ordering over all rules is needed
    return kept.select(F.xxhash64("tokens").alias("rule"), "tokens", "confidence", "covered", "key")


def _dealt(items: Column) -> Column:
    """The basket itself, or, of a larger one, baskets of three groups of GROUP tokens each, that hold each three of its tokens together."""
    groups = F.ceil(F.size(items) / GROUP).cast("int")
    group = lambda i: F.slice(items, i * GROUP + 1, GROUP)
    last = lambda i, j: F.transform(F.sequence(j + 1, groups - 1), lambda k: F.concat(group(i), group(j), group(k)))
    middle = lambda i: F.flatten(F.transform(F.sequence(i + 1, groups - 2), lambda j: last(i, j)))
    dealt = F.flatten(F.transform(F.sequence(F.lit(0), groups - 3), middle))
    return F.when(F.size(items) > ITEMS, dealt).otherwise(F.array(items))


def _parts(tokens_: Column) -> Column:
    """All smaller combinations of two or three tokens."""
    drop = lambda at: F.filter(tokens_, lambda t, i: i != at)
    fewer = F.transform(F.sequence(F.lit(0), F.size(tokens_) - 1), drop)
    single = F.transform(tokens_, lambda t: F.array(t))
    return F.when(F.size(tokens_) == 3, F.concat(fewer, single)).when(F.size(tokens_) == 2, single).otherwise(F.array().cast("array<array<string>>"))


def _keyed(sets: DataFrame, common: DataFrame) -> DataFrame:
    """``sets`` with ``key``: the token of each that is rarest in ``common`` ``(token, freq)``, the first by name of equals."""
    each = sets.select("*", F.explode("tokens").alias("token")).join(F.broadcast(common.select("token", F.col("freq").alias("__freq"))), "token")
    return each.groupBy("tokens").agg(
        *[F.any_value(c).alias(c) for c in sets.columns if c != "tokens"], F.min_by("token", F.struct("__freq", "token")).alias("key")
    )


def matches(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url") -> DataFrame:
    """The different ``id_col`` whose url holds all tokens of a rule (inverted index on the rules' rarest tokens).

    Null urls and urls without a host hold no token; ids may be null or repeat; without
    a rule or a url the result is empty; other columns are not read.
    """
    index = rules.select("key", F.col("tokens").alias("needed"))
    if rules.count() <= SENT:
        index = F.broadcast(index)
    held = urls.select(F.col(id_col).alias("__id"), tokens(F.col(url_col)).alias("items"))
    met = held.select("__id", "items", F.explode("items").alias("key")).join(index, "key")
    return met.where(F.size(F.array_except("needed", "items")) == 0).select(F.col("__id").alias(id_col)).distinct()


def judge(
    pages: DataFrame,
    labels: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple = RULES,
    **options,
) -> DataFrame:
    """``(id_col, host, path, rule, verdict)``, one row for each row of ``pages``.

    ``verdict``: that of the longest explicit rule; else block if a mined rule
    matches, and allow.  ``labels`` has ``(url, bad)`` rows to mine; null labels are
    left out, and without any bad url nothing is mined.  Null urls and urls without
    ``://`` have an empty host and path and no tokens.  Ids may be null or repeat:
    a url is judged by itself.  An empty table gives an empty result; other columns
    are not read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, says = explicit(host, path, rules)
    judged = rows.select("id", "url", host.alias("host"), path.alias("path"), name.alias("rule"), says.alias("says"))
    if labels is None:
        blocked = F.lit(False)
    else:
        mined = checkpointed(mine(labels, **options))
        open_urls = judged.where("rule IS NULL").select("url").where("url IS NOT NULL").distinct()
        hits = matches(open_urls, mined, "url").select(F.col("url").alias("__url"), F.lit(True).alias("__hit"))
        judged = judged.join(hits, judged.url == F.col("__url"), "left")
        blocked = F.coalesce(F.col("__hit"), F.lit(False))
    verdict = F.coalesce(F.col("says"), F.when(blocked, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


def page_labels(pages: DataFrame, labels: DataFrame, url_col: str = "url", doc_col: str = "doc_id") -> DataFrame:
    """``(url, bad)`` of pages whose url ends in the number of a labelled document.

    Bad is toxic or of quality 0; labels that contradict each other count as bad, null marks
    as good ones.  Null urls, urls without a number and null documents give no row; repeated
    urls each give theirs; other columns are not read.
    """
    number = F.regexp_extract(path_of(F.col(url_col)), r"/(\d{1,18})(?:\.\w+)?/?$", 1).try_cast("long")
    known = labels.groupBy(F.col(doc_col).alias("doc")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    named = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), number.alias("doc"))
    return named.join(known, "doc").select("url", "bad")
