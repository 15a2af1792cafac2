"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
ROUNDS = 100
#: Prior means of the share of good documents and of a rule's rate of bad votes (among its votes) on good and on bad
#: documents, and the weight of each of these priors in documents, whatever the number of documents.
GOOD, WRONG, RIGHT, MASS = 0.9, 0.05, 0.3, 40
#: A document is kept where its posterior probability of good quality is at least this.
THRESHOLD = 0.5


def text_stats(text: Column) -> list[tuple[str, Column]]:
    """Columns to add one after the other: the base counts and what the rules need besides. A null text reads as empty."""
    words, lines, hashes, sorted_, places = (F.col(c) for c in ("__words", "__lines", "__windows", "__sorted", "__places"))
    n = F.col("n_words")
    has_word = r"[^\x20\x09-\x0D]"
    twin = lambda x, k: ((k > 0) & (F.get(sorted_, k - 1)["h"] == x["h"])) | F.coalesce(F.get(sorted_, k + 1)["h"] == x["h"], F.lit(False))
    return [
        ("__text", F.coalesce(text, F.lit(""))),
        ("__words", F.array_remove(F.split("__text", BLANKS), "")),
        ("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(has_word))),
        ("n_words", F.size(words).cast("long")),
        ("word_chars", F.char_length(F.array_join(words, "")).cast("long")),
        ("n_symbols", F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long")),
        ("n_lines", F.size(lines).cast("long")),
        ("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")),
        ("n_closed_lines", F.size(F.filter(lines, lambda x: x.rlike(r"[.!?:;,\"'»)\]]\s*$"))).cast("long")),
        # A word counts from its first symbol to its end, a line likewise.
        ("n_symbol_words", F.regexp_count("__text", F.lit(r"[#*$%&|<>][^\x20\x09-\x0D]*")).cast("long")),
        ("n_symbol_lines", F.regexp_count("__text", F.lit(r"[#*$%&|<>][^\n]*")).cast("long")),
        ("n_bare_words", F.regexp_count("__text", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")).cast("long")),
        ("n_marks", F.regexp_count("__text", F.lit(r"[.!?]")).cast("long")),
        ("n_upper", F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("long")),
        ("n_lower", F.regexp_count("__text", F.lit(r"\p{Ll}")).cast("long")),
        ("__hashes", F.transform(words, lambda w: F.xxhash64(w))),
        ("n_doubled", F.size(F.filter("__hashes", lambda h, i: h == F.get(F.col("__hashes"), i + 1))).cast("long")),
        ("n_distinct", F.size(F.array_distinct("__hashes")).cast("long")),
        ("__windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1)).cast("int")), lambda i: F.xxhash64(F.slice(F.col("__hashes"), i, WINDOW)))).otherwise(F.array().cast("array<long>"))),
        # Most texts repeat no window: only those that do are sorted.
        ("__sorted", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))),
        ("__places", F.sort_array(F.transform(F.filter(sorted_, twin), lambda x: x["i"]))),
        ("n_repeat_words", F.coalesce(F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"]), F.lit(0)).cast("long")),
    ]


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    n = F.col("n_words")
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    length, symbols = share("word_chars", "n_words"), share("n_symbols", "n_words")
    upper = F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    closed = share("n_closed_lines", "n_lines")
    return {
        "size": vote(n < 30, n >= 80),
        "word_length": vote((length < 2.5) | (length > 15), (length >= 3) & (length <= 11)),
        "symbols": vote(symbols > 0.1, symbols < 0.03),
        "symbol_words": vote(share("n_symbol_words", "n_words") > 0.1, share("n_symbol_words", "n_words") < 0.02),
        "symbol_lines": vote(share("n_symbol_lines", "n_lines") > 0.5, share("n_symbol_lines", "n_lines") < 0.2),
        "bare_words": vote(share("n_bare_words", "n_words") > 0.2, share("n_bare_words", "n_words") < 0.05),
        "dup_lines": vote((F.col("n_lines") >= 4) & (share("n_dup_lines", "n_lines") > 0.3), (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "repeats": vote((n >= 40) & (share("n_repeat_words", "n_words") > 0.15), share("n_repeat_words", "n_words") < 0.02),
        "doubled": vote(share("n_doubled", "n_words") > 0.2, share("n_doubled", "n_words") < 0.03),
        "variety": vote((n >= 30) & (share("n_distinct", "n_words") < 0.25), share("n_distinct", "n_words") > 0.45),
        "case": vote(upper > 0.4, (upper < 0.15) & (F.col("n_lower") > 0)),
        "endings": vote(closed < 0.2, closed > 0.7),
        "sentences": vote(n > 40 * F.greatest(F.col("n_marks"), F.lit(1)), (n >= 2 * F.col("n_marks")) & (n <= 25 * F.col("n_marks"))),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over counts of vote patterns, of which there are at most 3**n_rules.

    Returns the log odds of good quality and, for each rule and vote, what the vote adds to them. Votes of a rule are
    independent given the quality, and a rule has two rates: how often it votes bad, when it votes, on good and on bad
    documents. Abstentions count as missing votes: they follow a text's length, not its quality, and would split short texts
    from long ones if they had rates. Every rate has a Beta prior worth MASS documents, which tells the qualities apart at
    the start and gives way to the data after that. So a rule whose bad votes no other rule backs loses its weight, one that
    others back gains it, and no vote has a weight or sign of its own.
    """
    posterior: list[float] = []
    prior, rates = math.log(GOOD / (1 - GOOD)), [(WRONG, RIGHT)] * n_rules
    for _ in range(ROUNDS):
        tables = [{0: 0.0, -1: math.log(g / b), 1: math.log((1 - g) / (1 - b))} for g, b in rates]
        before, posterior = posterior, [1 / (1 + math.exp(-max(-35.0, min(35.0, prior + sum(t[v] for t, v in zip(tables, p, strict=True)))))) for p, _ in patterns]
        if before and max((abs(x - y) for x, y in zip(before, posterior, strict=True)), default=0.0) < 1e-9:
            break
        good = sum(q * c for q, (_, c) in zip(posterior, patterns, strict=True))
        bad = sum((1 - q) * c for q, (_, c) in zip(posterior, patterns, strict=True))
        prior = math.log((good + GOOD * MASS) / (bad + (1 - GOOD) * MASS))
        rates = []
        for r in range(n_rules):
            seen = {(v, k): 0.0 for v in (-1, 0, 1) for k in (0, 1)}
            for q, (p, c) in zip(posterior, patterns, strict=True):
                seen[p[r], 1] += q * c
                seen[p[r], 0] += (1 - q) * c
            rates.append(tuple((seen[-1, k] + mean * MASS) / (seen[-1, k] + seen[1, k] + MASS) for k, mean in ((1, WRONG), (0, RIGHT))))
    return prior, [{0: 0.0, -1: math.log(g / b), 1: math.log((1 - g) / (1 - b))} for g, b in rates]


def base_failed() -> Column:
    """The base filter's verdict on the counts: too few words, or too large a share in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with base counts, votes (vote_ and the rule's name) and `quality`, the posterior
    probability of good quality. Columns of `keep` give way to added ones of the same name.

    The rules are weighed over all documents that pass the base filter, which alone depend on them. Counts are made once
    and kept as a narrow table; the votes' patterns, a bounded number, are counted over all rows and weighed on the driver.
    An empty table gives no rows; a null or empty text has counts of 0; repeated rows count and are judged one by one. A
    text's counts are made within one row, so a very long text takes one task's memory a few times its size.
    """
    votes = rules()
    made = {*BASE, "quality", *(f"vote_{k}" for k in votes)}
    keep = [c for c in keep if c.lower() not in made]
    names = [f"__keep{i}" for i in range(len(keep))]
    out = docs.select(*[docs[c].alias(k) for c, k in zip(keep, names, strict=True)], docs["text"].alias("__source"))
    for name, column in text_stats(F.col("__source")):
        out = out.withColumn(name, column)
    out = out.select(*[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], *BASE, *[v.cast("int").alias(f"vote_{k}") for k, v in votes.items()])
    out = materialize(out, "quality-votes")
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[:-1]), r[-1]) for r in out.where(~base_failed()).groupBy(*names).count().orderBy(*names).collect()]
    prior, tables = fit(patterns, len(names))
    total = F.lit(prior)
    for name, table in zip(names, tables, strict=True):
        total = total + F.when(F.col(name) > 0, table[1]).when(F.col(name) < 0, table[-1]).otherwise(0.0)
    return out.withColumn("quality", 1 / (1 + F.exp(-total)))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every document: the base counts, base_failed, kept, and the posterior quality. A null text has counts of
    0 and fails the base; rows that repeat an id are judged one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, ["doc_id"])
    failed = base_failed()
    return judged.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("quality") >= THRESHOLD)).alias("kept"), "quality")
