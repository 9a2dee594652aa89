"""URL filters: listed rules first, else logistic regression on hashed character n-grams
of host and path, trained from a small labelled URL table.

All of it is DataFrame and SQL functions: parsing, suffixes of the host for the rules, n-grams by
``transform`` over positions, hashing and scoring.  The model has ``2**bits`` weights at most.

Defined cases: a null URL, or one without ``://``, has empty host and path and the verdict
that the model gives to empty features; repeated rows are judged alike; of two rules that
fit, the longest written one wins, then the first by text; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 16
THRESHOLD = 0.5
BAD_SHARE = 0.2  # what the labels to block weigh in the fit: an unknown host is more likely a good one
SIZES = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract, as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# The small labelled table: hosts of two stems of the same label (1: block), or of a stem and a
# neutral word, each put into the shapes below, and whole URLs.  Words were chosen by subject
# (betting, adult, pharmacy, malware, advertising, link selling; and public bodies, trades, nature,
# study), not from any pages.  A model knows the words it was given: a user with other subjects
# trains on a table of theirs.
STEMS = {
    1: """poker jackpot roulette blackjack betting wager odds spins slots lottery bingo bookmaker xxx porn sexy cams escort nude hookup viagra meds pharma slimming steroid
    banner popup doubleclick affiliate clickbait phish malware crack warez keygen torrent ransom bulkmail backlink linkseller seo payday loan forex hack fake""".split(),
    0: """library museum school college hospital council parish embassy ministry archive theatre orchestra gallery bakery carpenter plumber gardener optician dentist architect
    river forest mountain valley island meadow harbour lighthouse weather climate geology botany astronomy history grammar philosophy algebra chemistry physics
    recipe kitchen cycling hiking sailing football chess painting pottery knitting newspaper journal bulletin timetable railway airport""".split(),
}
APART = (4, 13)
NEUTRAL = "my best world online group plus info home first city".split()  # beside words of either label
SHAPES = ("http://{}.com/index.php?p=3", "https://www.{}.org/a/b/page.htm", "http://shop.{}.net/list/en/7", "https://m.{}.co.uk/fr/4", "http://{}.example.edu/node/12")
LABELLED = {
    1: """http://banner.shop-deals.com/click?id=1 https://pixel.affiliate-media.com/pixel.gif http://best-poker.club/jackpot https://roulette-bonus.biz/bonus
    http://xxx-videos.com/porn/12 https://sexy-cams.com/live http://lottery-prize.click/claim http://phish-login.com/verify/account
    http://malware-download.com/crack.exe https://backlink-seo.com/buy http://doubleclick.popup.net/iframe http://keygen-warez.com/torrent""".split(),
    0: """https://en.encyclopedia.org/wiki/Spark https://docs.python.org/3/library/re.html https://news.daily-paper.com/politics/2024/05/01/budget.html
    https://www.university.edu/research/papers/12.pdf https://blog.engineer.com/posts/how-joins-work https://library.city.gov/catalog/item/99
    https://www.recipes.com/en/soup/lentil https://forum.gardeners.org/thread/4411 https://www.hospital.org/patients/visiting https://shop.books.com/en/novels/3
    http://x.org/ https://y.com/ https://z.net/about https://q.edu/ http://k.org/de/""".split(),
}


def urls_of(words: list[str]) -> list[str]:
    """URLs whose hosts are made of the words, two together or one beside a neutral word."""
    beside = lambda i: NEUTRAL[i % len(NEUTRAL)]
    hosts = [f"{a}-{b}" for i, a in enumerate(words) for b in (*[words[(i + k) % len(words)] for k in APART], beside(i))]
    return [shape.format(host) for host in hosts + [f"{beside(i + 3)}-{a}" for i, a in enumerate(words)] for shape in SHAPES]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) as a frame of literals."""
    rows = [(url, label) for label in (1, 0) for url in LABELLED[label] + urls_of(STEMS[label])]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{url}', {label}.0D)" for url, label in rows) + " AS t(url, label)")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path: from there up to ``?``, ``#`` or the end."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def ngrams(text: Column, tag: str, sizes: tuple[int, ...] = SIZES) -> Column:
    """The character n-grams of a text with its ends marked; each carries the tag."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    parts = [F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i, n=n: F.concat(F.lit(tag), F.substring(marked, i, F.lit(n))))).otherwise(F.array().cast("array<string>")) for n in sizes]
    return F.concat(*parts)


def features(urls: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds ``grams``, hashed to a sparse vector ``features``; host and path must be there."""
    # Digits say nothing about a host or path: each run becomes one 0.  Parts of a host are
    # alike whether a dot or a hyphen parts them.
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), "[0-9]+", "0"), "[.-]+", ".")
    grams = urls.withColumn("grams", F.concat(ngrams(plain("host"), "h"), ngrams(plain("path"), "p")))
    return HashingTF(numFeatures=1 << bits, binary=True, inputCol="grams", outputCol="features").transform(grams)


def train(spark: SparkSession, labelled: DataFrame | None = None, bits: int = BITS) -> LogisticRegressionModel:
    """Fits on (url, label); the labels weigh ``BAD_SHARE`` and the rest, however many rows
    each has.  The table is small by contract."""
    rows = labelled if labelled is not None else labelled_urls(spark)
    host, path = host_path(F.col("url"))
    # A thousand rows: one partition, so that a step of the fit is one task.
    rows = features(rows.select(host.alias("host"), path.alias("path"), "label").coalesce(1), bits)
    share = rows.agg(F.avg("label")).first()[0]
    rows = rows.withColumn("weight", F.when(F.col("label") > 0, F.lit(BAD_SHARE / share)).otherwise(F.lit((1 - BAD_SHARE) / (1 - share))))
    return LogisticRegression(maxIter=60, regParam=0.0002, standardization=False, featuresCol="features", labelCol="label", weightCol="weight").fit(rows)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none."""
    fits = lambda h, p: ((host == F.lit(h)) | host.endswith("." + h)) & path.startswith(p)
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        best = F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(pages: DataFrame, model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, block_probability."""
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    scored = model.transform(features(rows, bits)).withColumn("block_probability", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("block_probability") > threshold, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "block_probability")
