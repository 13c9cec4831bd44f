"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

A small labelled URL table trains the model (Spark's own LogisticRegression over HashingTF buckets), so the main path is
DataFrame expressions only. The table holds no host of the pages it is tried on.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the model's verdict on empty
text; rows are judged one by one, so a null or repeated page_id changes nothing; a very long url is judged whole, by its distinct
n-grams; an empty table gives no rows; ties between rules of one length cannot occur, since a host suffix and a path prefix of one
url with one length are one rule, except for equal strings, of which the first given counts. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm.common import table

#: The rules (verdict, host, path) of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Words that hosts to block are made of, words of other hosts, words that go with both, and syllables of plain names.
UNWANTED = ("casino", "poker", "bets", "slots", "pills", "viagra", "loans", "adult", "porn", "cams", "spam", "prizes", "ads", "tracker", "clicks")
WANTED = ("library", "news", "university", "museum", "docs", "garden", "forum", "council", "recipes", "weather", "journal", "school", "travel", "history", "science")
EITHER = ("best", "online", "hot", "top", "my", "club", "zone", "247", "deal", "world")
SYLLABLES = ("an", "be", "cor", "den", "el", "fi", "gar", "hol", "in", "jor", "ka", "lu", "mer", "ni", "or", "pel", "qui", "ros", "sta", "tur", "ul", "ven", "wes", "ther", "tion", "ing", "re", "ed", "sh", "ble")
SITES = ("test", "example.org", "example.net", "example.com")
SUBDOMAINS = ("", "www.", "m.", "blog.")
FORMS = ("{1}-{0}", "{0}{1}", "{0}-{1}", "{1}{0}", "{0}", "{1}-{0}-{2}")
PATHS = ("", "/", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2&ref=x", "/item/{}#top", "/buy/{}", "/a/b/{}", "/index.html")


def labelled_urls() -> list[tuple[str, int, str]]:
    """The small labelled URL table that trains the default model, by rule: url, label (1: block), the host's own name. Each word
    comes in FORMS of names, joined to words that go with both labels, and plain names of two or three syllables are allowed. Sites,
    subdomains and paths are dealt out alike to both, so that only names tell."""
    both = [(w, label) for pair in zip(UNWANTED, WANTED) for w, label in zip(pair, (1, 0))]
    names = [(form.format(w, *(EITHER[(i // 2 + 3 * k + j) % len(EITHER)] for j in (0, 4))), label) for i, (w, label) in enumerate(both) for k, form in enumerate(FORMS)]
    n, k = len(SYLLABLES), len(FORMS)
    url = lambda c, name: f"http{'s' * (c % 2)}://{SUBDOMAINS[c // 2 % 4]}{name}.{SITES[c // 3 % 4]}{PATHS[c % 10].format(17 * c + 5)}"
    # a word to block and one to allow have the same surroundings
    out = [(url(i // (2 * k) * k + i % k + 91 * again, name), label, name) for again in range(2) for i, (name, label) in enumerate(names)]
    plain = [SYLLABLES[i % n] + SYLLABLES[(5 * i + 3) % n] + (SYLLABLES[(11 * i + 7) % n] if i % 3 else "") for i in range(4 * n)]
    return out + [(url(7 * i, name), 0, name) for i, name in enumerate(plain)]


DIMENSIONS = 1 << 14


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column, sizes=(3, 4)) -> Column:
    """Character n-grams of host and path, with a mark at both ends and one between them."""
    # by an array of characters, as a character's place in a text is found by counting from its start; as a variable, made once
    whole = F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "")

    def of(letters: Column) -> Column:
        one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(letters, i, n), ""))
        return F.concat(*[one(n) for n in sizes])

    return F.transform(F.array(whole), of)[0]


def features(urls: DataFrame) -> DataFrame:
    """Adds host, path and the hashed n-gram vector `_x`."""
    out = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("_g", grams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=DIMENSIONS, binary=True, inputCol="_g", outputCol="_x").transform(out).drop("_g")


def fit(labelled: DataFrame, reg: float = 0.001) -> LogisticRegressionModel:
    """labelled: url string, label 0 or 1 (1: block), a small table. Rows without url or label don't count."""
    rows = features(labelled.dropna(subset=["url", "label"])).withColumn("label", F.col("label").cast("double")).coalesce(1)
    return LogisticRegression(featuresCol="_x", regParam=reg, maxIter=60, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c").fit(rows)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; nulls where none fits."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return text, verdict


def judge(pages: DataFrame, model: LogisticRegressionModel, rules=RULES) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict, score (the model's probability of block)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features(pages.select("page_id", "url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = vector_to_array("_p")[1]
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def default_model(spark: SparkSession) -> LogisticRegressionModel:
    return fit(spark.createDataFrame([row[:2] for row in labelled_urls()], "url string, label int"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), default_model(spark))
