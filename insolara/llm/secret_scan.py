"""Secrets in texts: candidates by form, false positives removed by a random forest.

A candidate is every run of 16 or more key characters inside a word, and the value of any length behind
an announcing assignment (``password=hunter2``, ``token : x1``). Its features are its length and
character classes, the changes between classes from one character to the next, the share of it that
frequent short words of the corpus cover, signs of a path, and the words around it. A random forest
learned from labelled findings gives the probability that it is a secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.llm.common import SPACE, prepare, stored, text_of
from insolara.llm.fingerprints import BLANKS

# a run of key characters; "=" is its padding only where no value follows
CORE = r"[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\"'`-]))?"
# Words that announce a secret.
ANNOUNCES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|key|auth|bearer|credentials?)"

# An announcing name, then "=" or ":"; and what may follow it as a value, up to the next run.
ASSIGNS = ANNOUNCES + r"[A-Za-z0-9_.-]{0,40}[\"'`]?(:=|=>|={1,2}|:)"
VALUE = r"(?:(?![A-Za-z0-9+/_-]{16})[^\s\"'`,;&<>(){}\[\]])+(?<![.:?])"
CANDIDATE = f"{CORE}|(?<={ASSIGNS}[\"'`]?)(?![=>]){VALUE}"
MARK, LED = "\x01", "key="

FEATURES = ("length", "digits", "uppers", "lowers", "marks", "changes", "hex_only", "distinct", "covered", "is_mail",
            "is_path", "assigned", "announced", "quoted", "prefixed", "letters_before",
            "names")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_no, word, place, core, head, tail, before, after, announce): each candidate of ``docs(doc_id, text)``.

    ``word_no`` counts words from 0, ``place`` the characters of the word before the candidate; ``head`` is what
    leads to it inside its word since the last separator, ``tail`` what follows it; ``before`` is the word before
    its word, ``announce`` the three before. Whole texts are read; NULL text has no words; repeated rows give
    their candidates again.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.split(F.trim(text_of(), F.lit(BLANKS)), SPACE).alias("w"))

    def shifted(by: int) -> Column:
        """The words behind ``by`` blanks: at each place the word that stands ``by`` before it."""
        return F.concat(F.array(*[F.lit("")] * by), F.col("w"))

    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size("w") - 1).alias("word_no"), F.col("w").alias("word"),
                          shifted(1).alias("one"), shifted(2).alias("two"), shifted(3).alias("three"),
                          F.slice("w", F.lit(2), F.size("w")).alias("after"))

    def may_hold(x: Column) -> Column:
        """Long words, and words that an assignment stands in or before."""
        return (F.length(x["word"]) >= 16) | x["word"].contains("=") | x["word"].contains(":") | x["one"].endswith(
            "=") | x["one"].endswith(":") | x["one"].endswith("=>")

    kept = words.select("doc_id", F.filter(zipped, may_hold).alias("kept"))
    # the outer form, since the plain one would add a filter that builds the arrays once more
    found = kept.select("doc_id", F.explode_outer("kept").alias("f")).filter("f IS NOT NULL").select(
        "doc_id", "f.word_no", "f.word", F.col("f.one").alias("before"), F.coalesce("f.after", F.lit("")).alias("after"),
        F.col("f.two").alias("two"), F.concat_ws(" ", "f.three", "f.two", "f.one").alias("announce"))
    # an assignment that ends in the word before, or is that word, stands for one inside the word
    sign = F.col("before").rlike("^(:=|=>|={1,2}|:)$")
    led = F.concat(F.when(sign, F.col("two")).otherwise(F.lit("")), F.col("before")).rlike(ASSIGNS + "$")
    opened = F.col("word").rlike("^(:=|=>|={1,2}|:).") & F.concat("before", F.lit("=")).rlike(ASSIGNS + "$")
    extra = F.when(led, F.lit(LED)).when(opened, F.lit(LED[:-1])).otherwise(F.lit(""))
    marked = F.regexp_replace(F.concat("extra", F.translate("word", MARK, "\x02")), f"({CANDIDATE})", f"{MARK}$1{MARK}")
    parts = found.withColumn("extra", extra).withColumn("parts", F.split(marked, MARK)).filter(F.size("parts") > 1)
    # every second part is a candidate
    each = F.transform(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)), lambda i: F.struct(
        F.get("parts", i).alias("core"), F.substring(F.array_join(F.slice("parts", F.lit(1), i), ""), F.length("extra") + 1, F.length(
            "word")).alias("head"), F.get("parts", i + 1).alias("tail")))
    return parts.select("doc_id", "word_no", "word", "before", "after", "announce", F.explode(each).alias("c")).select(
        "doc_id", "word_no", "word", F.length("c.head").alias("place"), "c.core", F.regexp_extract("c.head", r"[^,;&?{}]*$", 0).alias("head"),
        "c.tail", "before", "after", "announce")


def frequent_words(docs: DataFrame, n: int = 200) -> list[str]:
    """The ``n`` most frequent words of 2 to 6 letters, counted over all texts; the size of the dictionary is fixed."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of()), F.lit(r"(?<![\p{L}0-9])([a-z]{2,6})(?![\p{L}0-9])"), 1))
                        .alias("w"))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(n)
    return [r[0] for r in top.collect()]


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """``found`` of :func:`candidates` with the columns named by FEATURES."""
    core = F.col("core")
    size = F.length(core)
    head = F.col("head")

    def share(of: str) -> Column:
        return F.regexp_count(core, F.lit(of)) / size

    longest_first = sorted(dictionary, key=lambda w: (-len(w), w))
    rest = F.regexp_replace(F.lower(core), "|".join(longest_first), "") if longest_first else core
    changes = r"(?=[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]|[+/_-][A-Za-z0-9]|[A-Za-z0-9][+/_-])"
    columns: dict[str, Column] = {
        "length": size, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"),
        "marks": share("[+/_=-]"), "changes": F.regexp_count(core, F.lit(changes)) / size,
        "hex_only": core.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("int"),
        "distinct": F.array_size(F.array_distinct(F.split(core, ""))) / size, "covered": 1 - F.length(rest) / size,
        "is_mail": F.col("word").contains("@").cast("int"),
        "is_path": (F.col("word").rlike(r"://|www\.|\.(com|org|net|html?)\b") | (F.regexp_count(core, F.lit("/")) >= 2)).cast("int"),
        "assigned": (head.rlike("[=:]") | F.col("before").rlike("(=>|[=:])$")).cast("int"),
        "announced": (head.rlike(ANNOUNCES) | F.col("announce").rlike(ANNOUNCES)).cast("int"),
        "quoted": head.rlike("[\"'`]$").cast("int"), "prefixed": (F.length(head) > 0).cast("int"),
        "letters_before": F.col("before").rlike(r"^\p{L}+[.,;]?$").cast("int"),
        "names": F.col("tail").rlike("^[\"'`]?(:=|=>|=|:(?!//))").cast("int"),
    }
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


def labelled_findings(found: DataFrame, sample_rows: int = 20_000, seed: int = 3) -> DataFrame:
    """Labelled findings drawn from candidates with their features, where no reviewed ones are at hand.

    Secret: assigned to an announcing name (if below 16 characters: 6 or more, letters and digits), or of a
    published key format (AKIA and 16 characters). Not: one class of characters only, a mail address, or a path
    without either sign; a name that is assigned to; fewer than 4 characters. The rest has no label. Each class gives
    about ``sample_rows`` / 2 rows at most, by a hash; that is the documented bound of the fit.
    """
    strong = (F.col("length") >= 16) | ((F.col("length") >= 6) & (F.col("digits") > 0) & (F.col("lowers") + F.col("uppers") > 0))
    known = F.col("core").rlike("^AKIA[0-9A-Z]{16}$") | (
        (F.col("assigned") == 1) & (F.col("announced") == 1) & (F.col("names") == 0) & strong)
    plain = (F.col("lowers") == 1) | (F.col("uppers") == 1) | (F.col("digits") == 1) | (F.col("is_mail") == 1) | (
        F.col("is_path") == 1)
    no_value = (F.col("length") < 4) | ((F.col("names") == 1) & (F.col("assigned") == 0))
    label = F.when(known, 1.0).when((plain & (F.col("announced") == 0)) | no_value, 0.0)
    marked = found.withColumn("label", label).filter("label IS NOT NULL")
    order = F.xxhash64(F.lit(seed), F.col("core"), F.col("word"))
    halves = [marked.filter(F.col("label") == v).orderBy(order, "core", "word", *FEATURES).limit(sample_rows // 2)
              for v in (0.0, 1.0)]
    return reduce(DataFrame.union, halves).select("label", *FEATURES)


def learn(labelled: DataFrame, trees: int = 20, depth: int = 6, seed: int = 5) -> RandomForestClassificationModel | None:
    """A random forest over ``labelled(label, FEATURES...)``; None if there are not both kinds."""
    if labelled.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def scan(docs: DataFrame, labelled: DataFrame | None = None, least: float = 0.5, sample_rows: int = 20_000) -> DataFrame:
    """(doc_id, word_no, secret, probability) of each secret in ``docs(doc_id, text)``.

    ``labelled`` holds reviewed findings with a label and FEATURES; without them, findings are labelled
    by :func:`labelled_findings`. If one kind is missing, nothing is learned and candidates that are
    assigned to an announcing name are returned with probability 1. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    dictionary = frequent_words(docs)
    found = stored(with_features(candidates(docs), dictionary), "findings")
    model = learn(stored(labelled if labelled is not None else labelled_findings(found, sample_rows), "labelled"))
    if model is None:
        sure = found.filter("assigned = 1 AND announced = 1").withColumn("probability", F.lit(1.0))
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
        judged = model.transform(rows.select("doc_id", "word_no", "core", "features"))
        sure = judged.withColumn("probability", F.get(vector_to_array("probability"), F.lit(1)))
    return sure.filter(F.col("probability") >= least).select("doc_id", "word_no", F.col("core").alias("secret"),
                                                             F.round("probability", 6).alias("probability"))
