"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule judges train two smoothed variable-order Markov models, one of
accepted and one of rejected urls, over the characters of the whole url as it stands.
A model interpolates all context lengths up to ``CONTEXT`` characters (Witten-Bell: the
less varied a context, the more it weighs; an unseen context falls back to the next
shorter one; below all stands an equal share for each character that occurs in urls).
A url's score is the difference of its log-likelihoods divided by its length.  The
threshold is calibrated on rule-judged urls held out of the counts: the cut with the
least sum of both error rates.

The model is a table with a row for each different stretch of ``CONTEXT`` + 1 characters,
so it grows with the urls.  Every url is cut into such stretches, which meet their ratios
in a join and are summed per url.  Stretches that make up 1 in ``COMMON`` or more of all
are at most ``COMMON`` rows, whatever the input: those are sent to the tasks, so frequent
hosts and schemes are summed without a shuffle; all others are joined by shuffle.  Which
way a stretch takes changes no result.  Ratios are whole micro-units, so sums don't
depend on the order of adding.

Defined cases: null and empty urls score 0; null urls and urls without ``://`` have an
empty host and path and no rule, and the latter are scored as any text.  Rows count and
are judged each by itself, repeated or not; equal urls get equal scores.  Of equally good
cuts the lowest is taken.  Very long urls are as many stretches as they have characters.
Without held-out urls of both kinds everything unruled is allowed; an empty table gives
an empty result.  Columns other than ``page_id`` and ``url`` aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folium.llm.common import let
from folium.session import stored

#: (verdict, rule): a rule is a host and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: Characters of context, and the mark that stands for those before the start.
CONTEXT = 6
START = "\x01"
#: A stretch that is 1 in so many of all, or more, is common.
COMMON = 100_000
#: Micro-units of log-likelihood a character in a bin of the calibration.
BIN = 10_000
KINDS = ("allow", "block")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule = verdict = None
    for kind, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule = (F.when if rule is None else rule.when)(fits, F.lit(text))
        verdict = (F.when if verdict is None else verdict.when)(fits, F.lit(kind))
    return rule, verdict


def parsed(pages: DataFrame) -> DataFrame:
    """The pages with host, path, rule and its verdict, and a number of each row, stored."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    ruled = split.withColumns({"rule": rule, "ruled": verdict})
    return stored(ruled.withColumn("row", F.monotonically_increasing_id()))


def stretches(url: Column) -> Column:
    """For each character of the url, it and the ``CONTEXT`` characters before it."""
    characters = F.array_remove(F.split(F.coalesce(url, F.lit("")), ""), "")

    def placed(s: Column) -> Column:
        def stretch(c: Column, i: Column) -> Column:
            before = [F.coalesce(F.get(s, i - back), F.lit(START)) for back in range(CONTEXT, 0, -1)]
            return F.concat(*before, c)

        return F.transform(s, stretch)

    return let(characters, placed)


def held_out(url: Column) -> Column:
    """A fixed 3 of 16 of the different urls."""
    return F.substring(F.md5(url), 1, 1).isin("0", "1", "2")


def counts(urls: DataFrame) -> DataFrame:
    """gram, n and how often it stands in accepted and in rejected urls to learn from."""
    kind = F.when(~held_out(F.col("url")), F.col("ruled"))
    return (
        urls.select(kind.alias("kind"), F.explode(stretches(F.col("url"))).alias("gram"))
        .groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))
    )


def all_orders(seen: DataFrame) -> DataFrame:
    """Every ending of a stretch with its counts and those of its context.

    The window is as long as there are characters that follow one context.
    """
    endings = F.array(*(F.substring("gram", CONTEXT + 1 - order, order + 1) for order in range(CONTEXT + 1)))
    counted = (
        seen.select(F.explode(endings).alias("gram"), "n", *(f"n_{k}" for k in KINDS))
        .groupBy("gram")
        .agg(F.sum("n").alias("n"), *(F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS))
        .withColumn("order", F.length("gram") - 1)
        .withColumn("context", F.left(F.col("gram"), F.col("order")))
    )
    same = Window.partitionBy("context")
    return counted.select(
        "gram",
        "order",
        "n",
        *(f"n_{k}" for k in KINDS),
        *(F.sum(f"n_{k}").over(same).alias(f"all_{k}") for k in KINDS),
        *(F.count_if(F.col(f"n_{k}") > 0).over(same).alias(f"kinds_{k}") for k in KINDS),
    )


def log_ratios(grams: DataFrame) -> DataFrame:
    """gram, n, ratio: micro-units of log P(accepted) - log P(rejected), for every whole stretch."""
    characters = grams.where("order = 0").agg(F.count(F.lit(1))).scalar()
    below = None
    for order in range(CONTEXT + 1):
        here = grams.where(F.col("order") == order)
        if below is None:
            here = here.withColumns({f"below_{k}": 1.0 / characters for k in KINDS})
        else:
            shorter = here.withColumn("shorter", F.substring("gram", 2, order))
            here = shorter.join(below.drop("n").withColumnRenamed("gram", "shorter"), "shorter")
        smoothed = (
            F.when(
                F.col(f"all_{k}") > 0,
                (F.col(f"n_{k}") + F.col(f"kinds_{k}") * F.col(f"below_{k}"))
                / (F.col(f"all_{k}") + F.col(f"kinds_{k}")),
            )
            .otherwise(F.col(f"below_{k}"))
            .alias(f"below_{k}")
            for k in KINDS
        )
        below = here.select("gram", "n", *smoothed)
    ratio = F.round(F.log(F.col("below_allow") / F.col("below_block")) * 1e6)
    return below.select("gram", "n", ratio.cast("long").alias("ratio"))


def train(urls: DataFrame) -> DataFrame:
    """The stored model: gram, n, ratio."""
    return stored(log_ratios(stored(all_orders(counts(urls)))))


def scored(urls: DataFrame, model: DataFrame, common: int = COMMON) -> DataFrame:
    """The urls with score_bin: log-likelihood difference a character, in bins of the calibration."""
    often = F.col("n") * common >= model.agg(F.sum("n")).scalar()
    frequent, rare = (model.where(kept).select("gram", "ratio") for kept in (often, ~often))
    places = urls.select("row", F.explode(stretches(F.col("url"))).alias("gram"))
    near = places.join(F.broadcast(frequent), "gram")
    far = places.join(F.broadcast(frequent.select("gram")), "gram", "left_anti").join(rare, "gram")
    sums = (
        near.unionByName(far)
        .groupBy("row")
        .agg(F.floor(F.sum("ratio") / F.count(F.lit(1)) / BIN).alias("score_bin"))
    )
    return urls.join(sums, "row", "left").withColumn("score_bin", F.coalesce("score_bin", F.lit(0).cast("long")))


def threshold(judged: DataFrame) -> DataFrame:
    """One row: the lowest bin that is allowed.

    The windows run over the histogram of scores a character: a ratio is at most the
    logarithm of the number of characters once an order, so some thousands of bins.
    """
    known = judged.where(F.col("ruled").isNotNull() & held_out(F.col("url")))
    bins = known.groupBy(F.col("score_bin").alias("cut")).agg(
        F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")
    )
    lower = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    risk = F.coalesce(F.sum("good").over(lower), F.lit(0)) * F.sum("bad").over(every) - F.coalesce(
        F.sum("bad").over(lower), F.lit(0)
    ) * F.sum("good").over(every)
    both = (F.sum("bad").over(every) > 0) & (F.sum("good").over(every) > 0)
    # Halfway to the next lower score that occurs.
    before = F.coalesce(F.lag("cut").over(Window.orderBy("cut")), F.col("cut"))
    return (
        bins.select("cut", before.alias("before"), risk.alias("risk"), both.alias("both"))
        .where("both")
        .agg(F.min(F.struct("risk", "cut", "before")).alias("best"))
        .select(F.ceil((F.col("best.cut") + F.col("best.before")) / 2).alias("cut"))
    )


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, score_bin, verdict of every page."""
    urls = parsed(pages)
    judged = stored(scored(urls, train(urls)))
    cut = stored(threshold(judged)).select("cut").scalar()
    by_model = F.when(F.col("score_bin") < cut, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", "score_bin", F.coalesce("ruled", by_model).alias("verdict")
    )
