"""URL filter: allow and block rules first, then a classifier on n-grams.

The classifier is a logistic regression on hashed character n-grams of host
and path, fitted on a small labelled URL table. Both fitting and scoring run in
the JVM through DataFrame expressions and pyspark.ml; no user functions.

Scoring is one projection over the table, without a shuffle, so a host with a
third of all rows costs nothing extra. The rules are configuration: they are
compiled into one CASE expression, and MAX_RULES bounds them.

Defined cases: a null url, or one without "://", has an empty host and path,
no rule, and the verdict allow, as nothing speaks against it; repeated rows are
judged alike; an empty table gives an empty table, and a labelled table without
rows an error; extra columns pass through,
and an input column with the name of an output column is replaced.
"""

from __future__ import annotations

import random
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, fresh_name

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
MAX_RULES = 2000
SEED = 3


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the production query.
RULES = (
    UrlRule("block", "com", "/en/"),
    UrlRule("allow", "example.com", "/en/7"),
    UrlRule("allow", "net", "/de/"),
    UrlRule("block", "example.net", "/de/8"),
    UrlRule("block", "org", "/es/"),
)

# The words of which the labelled URL table is made. First what
# betting, adult, pharmacy, advertising, fraud and malware sites call
# themselves; then the most common nouns of English, German, French and Spanish,
# and what ordinary sites call themselves. The rule is the subject, and nothing
# is taken in or left out because a table at hand holds it.
BAD = """
casino poker bingo jackpot roulette blackjack baccarat slots lottery lotto betting bet bets wager gamble gambling bookmaker bookie odds spins sportsbook keno
adult porn porno xxx sex sexy erotic erotica nude nudes naked escort escorts webcam camgirl fetish hardcore hentai swinger hookup stripper playmate
pills pill viagra cialis levitra pharmacy pharma meds drugs steroid steroids xanax valium tramadol prescription generic slimming detox weightloss diet keto botox enlargement testosterone
ads adserver adnet banner banners popup popunder tracker tracking clicks clickbait affiliate sponsored promo promos coupon coupons discount discounts deals offer offers voucher cashback
giveaway prize prizes winner winners freebie freebies free bonus gift gifts reward rewards sale cheap cheapest bargain leads traffic pixel
spam spammer scam scams phishing malware virus trojan spyware ransom keylogger botnet hack hacks hacked hacker crack cracks cracked keygen serial serials warez torrent torrents pirate nulled cheats exploit
fake replica replicas counterfeit clone payday loan loans credit debt refinance forex crypto bitcoin airdrop ponzi pyramid millionaire cash money instant income guaranteed miracle psychic horoscope dating singles brides
""".split()
GOOD = """
time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night
point home water room mother area story fact month study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name
president team minute idea body information parent face level office door health person art war history party result change morning reason research moment air teacher force education
jahr mensch zeit tag land stadt haus frau mann kind leben welt arbeit frage teil weg stunde wasser auge wort schule buch freund vater mutter familie woche monat abend nacht platz gesellschaft geschichte
temps annee jour homme femme enfant vie monde pays ville maison chose travail partie main mot nom ecole livre ami pere mere famille semaine mois matin nuit lieu route histoire langue
tiempo dia hombre mujer vida mundo pais ciudad casa cosa trabajo pregunta parte mano agua palabra nombre escuela libro amigo padre madre familia semana noche lugar camino historia
news blog forum wiki daily post press journal review guide museum library university college club music travel food sport weather science garden recipe photo film radio market studio village church
""".split()
BAD_PATHS = "/play /signup/now /download/setup /pics/hot /order/today /redirect".split()
GOOD_PATHS = "/about /news/today /en/1042 /de/articles/77.html /fr/page /es/2031/ /wiki/history /docs/guide".split()
FRONTS = ("", "www.", "m.", "blog.", "shop.")
ENDS = (".com", ".net", ".org", ".info", ".example.com", ".example.net", ".example.org")
#: URLs of each word, and ordinary hosts of invented names for each ordinary word.
EACH, INVENTED = 6, 8
# How syllables of European languages start, sound and end.
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn l m n p pl pr qu r s sch sh sl sp st str t th tr v w wh z".split()
VOWELS = "a e i o u ai au ea ee ei ie oo ou".split()
CODAS = ["", "", "", *"b ck d f g l ld lt m n nd ng nt p r rd rs rt s sh ss st t th x".split()]


def _invented(draw: random.Random) -> str:
    """A name that nobody has, of one to three syllables. It teaches that
    unknown letters alone block nothing."""
    return "".join(draw.choice(ONSETS) + draw.choice(VOWELS) + draw.choice(CODAS) for _ in range(draw.randint(1, 3)))


def labelled_urls(spark: SparkSession, bad: list[str] = BAD, good: list[str] = GOOD) -> DataFrame:
    """The small labelled table (url, blocked), made by rule of these words:
    hosts of a word, or of a word and another of its list, and ordinary hosts of
    invented names, under some fronts, ends and paths. Both kinds of hosts have
    ordinary paths too, so that a path alone blocks nothing."""
    rows, draw = [], random.Random(SEED)

    def add(name: str, k: int, paths: list[str], blocked: float) -> None:
        rows.append((f"https://{FRONTS[k % len(FRONTS)]}{name}{ENDS[k % len(ENDS)]}{paths[k % len(paths)]}", blocked))

    for words, paths, blocked in ((bad, GOOD_PATHS + BAD_PATHS, 1.0), (good, GOOD_PATHS, 0.0)):
        for i, word in enumerate(words):
            for j in range(EACH):
                other = words[(i + 7 * j) % len(words)]
                add((word, f"{word}-{other}", f"{other}{word}")[j % 3], i + j, paths, blocked)
    for i in range(INVENTED * len(good)):
        add("-".join(_invented(draw) for _ in range(1 + i % 2)), i, GOOD_PATHS, 0.0)
    return spark.createDataFrame(rows, "url string, blocked double").coalesce(1)


def _parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); else null. Of
    equally long rules block comes first, then the smaller text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a compiled table holds {MAX_RULES} at most")
    column = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "block", r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        made = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        column = F.when(fits, made) if column is None else column.when(fits, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if column is None else column


def _ngrams(text: Column, tag: str, n: int) -> Column:
    last = F.length(text) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(tag), F.substring(text, i, F.lit(n))))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def _grams(host: Column, path: Column) -> Column:
    """All n-grams of the host between marks, and of the path."""
    parts = [(F.concat(F.lit("^"), host, F.lit("$")), "h"), (path, "p")]
    out = []
    for n in SIZES:
        for text, tag in parts:
            out.append(_ngrams(text, tag, n))
    return F.array_distinct(F.concat(*out))


class UrlFilter:
    """A fitted filter: rules first, else the classifier."""

    def __init__(self, labelled: DataFrame, rules=RULES, threshold: float = 0.5, buckets: int = BUCKETS):
        self.rules, self.threshold = rules, threshold
        self._hash = HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features")
        host, path = _parts(F.col("url"))
        train = labelled.select(_grams(host, path).alias("grams"), F.col("blocked").alias("label"))
        if train.isEmpty():
            raise ValueError("no labelled URLs")
        self._model = LogisticRegression(maxIter=40, regParam=0.0005).fit(self._hash.transform(train))

    def apply(self, pages: DataFrame, url: str = "url") -> DataFrame:
        """pages with host, path, rule, verdict and block_score."""
        own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
        row = fresh_name(pages, "row")
        host, path = _parts(F.col(url).cast("string"))
        df = pages.select(F.struct(*own).alias(row), host.alias("host"), path.alias("path"))
        df = df.withColumn("grams", _grams(F.col("host"), F.col("path")))
        df = self._model.transform(self._hash.transform(df))
        score = F.when(F.col("host") == "", F.lit(0.0)).otherwise(vector_to_array("probability")[1])
        df = df.withColumn("block_score", score).withColumn("fit", rule_of(F.col("host"), F.col("path"), self.rules))
        learned = F.when(F.col("block_score") >= self.threshold, "block").otherwise("allow")
        return df.select(f"{row}.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", learned).alias("verdict"), "block_score")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return UrlFilter(labelled_urls(spark)).apply(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
