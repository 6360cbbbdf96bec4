"""Quality rules as weak supervision, with DataFrame operations only.

Rules vote for or against a document or abstain. Expectation-maximisation over the counts of vote patterns (at most
3^rules of them, whatever the corpus) estimates how often each rule is right, and the posterior probability of "good"
takes the place of a rule that all must pass.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm._shared import SPACE, SPACES, WORD, materialize, table, text_of

#: Words of a window, fewest words of a document, most per cent of its words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: From so many words on, the fewest different words grow with the root of the length.
LONG_WORDS = 2000
#: EM starts from this share of good documents and these chances of the votes (-1, 0, 1) in good and bad documents, for
#: rules that find junk and for the one that finds plain prose; they count as so large a share of the documents.
PRIOR, STRENGTH, ROUNDS = 0.85, 0.05, 60
JUNK = {True: (0.01, 0.989, 0.001), False: (0.2, 0.799, 0.001)}
PROSE = {True: (0.001, 0.1, 0.899), False: (0.001, 0.8, 0.199)}
#: Documents with a posterior under this go.
LEAST_POSTERIOR = 0.5

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_bang", "n_distinct"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__tw_f`` of counts over the whole text; null texts count as empty.

    Windows are compared by 64-bit hashes, built by doubling: 2, 4, then 8 words. Only documents that hold a hash twice
    pay for the sort that finds the covered words. The steps are separate projections, so that no array is made twice.
    """
    shift = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
    pair = lambda a, k: F.zip_with(a, shift(a, k), lambda x, y: F.xxhash64(x, y))
    c = F.col
    out = docs.withColumn("__tw_t", F.btrim(text_of(text), F.lit(SPACES)))
    out = out.withColumn("__tw_w", F.when(c("__tw_t") == "", F.array().cast("array<string>")).otherwise(F.split("__tw_t", SPACE + "+")))
    out = out.withColumn("__tw_n", F.size("__tw_w")).withColumn("__tw_h", F.transform("__tw_w", lambda x: F.xxhash64(x)))
    out = out.withColumn("__tw_l", F.filter(F.split(text_of(text), "\n", -1), lambda x: x.rlike(WORD)))
    out = out.withColumn("__tw_h2", pair(c("__tw_h"), 1)).withColumn("__tw_h4", pair(c("__tw_h2"), 2)).withColumn("__tw_h8", pair(c("__tw_h4"), 4))
    out = out.withColumn("__tw_h8", F.when(c("__tw_n") >= WINDOW, F.slice("__tw_h8", 1, F.greatest(c("__tw_n") - (WINDOW - 1), F.lit(0)))))
    out = out.withColumn("__tw_again", F.size(F.array_distinct("__tw_h8")) < F.size("__tw_h8"))
    out = out.withColumn("__tw_s", F.when(c("__tw_again"), F.sort_array(F.zip_with("__tw_h8", F.sequence(F.lit(0), F.size("__tw_h8") - 1), lambda h, p: F.struct(h.alias("h"), p.alias("p"))))))
    out = out.withColumn("__tw_e", F.zip_with("__tw_s", shift(c("__tw_s"), 1), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    out = out.withColumn("__tw_e", F.zip_with("__tw_e", F.concat(F.array(F.lit(False)), "__tw_e"), lambda a, b: F.coalesce(a, F.lit(False)) | b))
    out = out.withColumn("__tw_p", F.sort_array(F.filter(F.zip_with("__tw_s", "__tw_e", lambda a, e: F.when(e, a["p"])), lambda p: p.isNotNull())))
    gaps = F.zip_with("__tw_p", shift(c("__tw_p"), 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0))
    count = lambda pattern: F.regexp_count(text_of(text), F.lit(pattern))
    named = {
        "n_words": c("__tw_n"), "word_chars": F.length(F.translate(text_of(text), SPACES, "")), "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": F.size("__tw_l") - F.size(F.array_distinct("__tw_l")), "n_repeat_words": covered,
        "n_upper": count(r"\p{Lu}"), "n_letters": count(r"\p{L}"), "n_bang": count(r"!"), "n_distinct": F.size(F.array_distinct("__tw_h")),
    }
    return out.withColumn("__tw_f", F.struct(*(v.cast("long").alias(k) for k, v in named.items()))).select(*(F.col(f"`{x}`") for x in docs.columns), "__tw_f")


def votes(f) -> list[Column]:
    """Each 1 (good), -1 (bad) or 0 (abstains). ``f(name)``: a feature's column."""
    n = F.greatest(f("n_words"), F.lit(1))

    share = lambda k, of=n: f(k) / of

    length = f("word_chars") / n
    letters = share("n_letters", F.greatest(f("word_chars"), F.lit(1)))
    upper = share("n_upper", F.greatest(f("n_letters"), F.lit(1)))
    # one that finds junk of a certain kind tells nothing where it finds none, so it votes against or abstains
    junk = [
        share("n_symbols") > 0.1,
        upper > 0.35,
        share("n_bang") > 0.3,
        share("n_repeat_words") > 0.15,
        share("n_dup_lines") > 0.05,
        f("n_words") < LEAST_WORDS,
        (length > 14) | (length < 2),
        # different words grow with the root of the length in long texts
        f("n_distinct") < 0.25 * F.least(n, F.sqrt(n * LONG_WORDS)),
        letters < 0.7,
    ]
    prose = (share("n_symbols") <= 0.05) & (upper <= 0.2) & (share("n_bang") <= 0.1) & length.between(2.5, 12) & (letters > 0.65)
    return [*(F.when(x, -1).otherwise(0) for x in junk), F.when(prose, 1).otherwise(0)]


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """The posterior probability of "good" for each vote pattern, by EM over (pattern, count).

    Each rule has, for good and for bad documents, chances of its three votes; a Dirichlet prior in proportion to the
    corpus keeps "good" on the side of the votes for it, at every size alike.
    """
    if not patterns:
        return {}
    rules, total = len(patterns[0][0]), sum(n for _, n in patterns)
    start = [JUNK] * (rules - 1) + [PROSE]
    share, post = PRIOR, {}
    chance = {y: [dict(zip((-1, 0, 1), x[y], strict=True)) for x in start] for y in (True, False)}
    for _ in range(ROUNDS):
        for p, _n in patterns:
            odds = log(share / (1 - share)) + sum(log(chance[True][j][v] / chance[False][j][v]) for j, v in enumerate(p))
            post[p] = 1 / (1 + exp(-max(-60.0, min(60.0, odds))))
        for y in (True, False):
            own = [(p, n * (post[p] if y else 1 - post[p])) for p, n in patterns]
            prior = STRENGTH * total * (PRIOR if y else 1 - PRIOR)
            held = sum(n for _, n in own) + prior
            chance[y] = [{v: (sum(n for p, n in own if p[j] == v) + prior * start[j][y][v + 1]) / held for v in (-1, 0, 1)} for j in range(rules)]
        share = (sum(n * post[p] for p, n in patterns) + STRENGTH * total * PRIOR) / (total * (1 + STRENGTH))
    return post


def judge(featured: DataFrame) -> DataFrame:
    """``featured`` (with ``__tw_f``, written before) with base_failed, posterior and kept in ``__tw_v``."""
    f = lambda k: F.col(f"__tw_f.{k}")
    voted = featured.withColumn("__tw_votes", F.concat_ws("", *(F.element_at(F.array(F.lit("n"), F.lit("a"), F.lit("y")), (v + 2).cast("int")) for v in votes(f))))
    counts = [(tuple("nay".index(x) - 1 for x in r[0]), r[1]) for r in voted.groupBy("__tw_votes").count().collect()]  # 3^rules rows at most
    post = fit(sorted(counts))
    spark = featured.sparkSession
    known = F.broadcast(spark.createDataFrame([("".join("nay"[v + 1] for v in p), x) for p, x in post.items()], "__tw_votes string, __tw_post double"))
    failed = (f("n_words") < LEAST_WORDS) | (100 * f("n_repeat_words") > MOST_REPEATED * f("n_words"))
    verdict = F.struct(failed.alias("base_failed"), F.col("__tw_post").alias("posterior"), (~failed & (F.col("__tw_post") >= LEAST_POSTERIOR)).alias("kept"))
    return voted.join(known, "__tw_votes", "left").withColumn("__tw_v", verdict).drop("__tw_votes", "__tw_post")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``.

    Null and empty texts go; very long ones are judged whole; repeated rows are judged alike; an empty table gives none.
    """
    judged = judge(materialize(features(docs), "quality"))
    return judged.filter("__tw_v.kept").select(*(F.col(f"`{x}`") for x in docs.columns))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior, for every document.

    Null and empty texts have no words and fail; very long texts are counted whole; repeated rows are judged alike; an
    empty table gives no rows.
    """
    judged = judge(materialize(features(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__tw_f"), "quality"))
    return judged.select("doc_id", *(f"__tw_f.{x}" for x in FEATURES[:5]), "__tw_v.base_failed", "__tw_v.kept", "__tw_v.posterior")
