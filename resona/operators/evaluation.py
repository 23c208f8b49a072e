"""Evaluation: decisions of the correction loop, confusion counts, threshold grids, sessions, term statistics, classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from resona.functions.text import FAULT_KEYWORDS, STOP_WORDS, affirmed, denied, fold_turkish, negated, term_counts, terms


# What a diagnosed fault's name holds, its keywords, and those of the fault that it excludes.
RIVALS = [
    (["inner", "bpfi"], "inner_race_fault", "outer_race_fault"),
    (["outer", "bpfo"], "outer_race_fault", "inner_race_fault"),
    (["unbalance", "dengesizlik"], "unbalance", "misalignment"),
    (["misalignment", "hizasızlık", "kaçıklık"], "misalignment", "unbalance"),
]


def consistency(text: Column, fault: Column, zone: Column) -> Column:
    """Struct of fault_mismatch, zone_mismatch and passed: whether a text contradicts the diagnosed fault or severity zone.

    fault: a name by any of RIVALS, the first that fits; other faults and null pass. A text contradicts if it affirms
    the excluded fault or denies the diagnosed one. zone: the last letter of its name counts; null and blank pass.
    """
    name, own, other = fold_turkish(fault), F, F
    for parts, mine, rival in RIVALS:
        called = F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(name, p))
        own, other = own.when(called, terms(FAULT_KEYWORDS[mine])), other.when(called, terms(FAULT_KEYWORDS[rival]))
    bad = F.coalesce(affirmed(text, other) | denied(text, own), F.lit(False))
    letter = F.upper(F.right(F.trim(zone), F.lit(1)))
    claims = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\bzone\s*([a-d])\b"), F.lit(1)))
    claim = lambda x: F.struct(F.concat(F.lit("zone "), x).alias("name"), F.array(F.lit("zone"), x).alias("words"))
    wrong = F.exists(claims, lambda x: (F.upper(x) != letter) & ~negated(text, claim(x)))
    wrong = F.coalesce(wrong, F.lit(False))
    return F.struct(bad.alias("fault_mismatch"), wrong.alias("zone_mismatch"), (~bad & ~wrong).alias("passed"))


def decide(state: DataFrame, max_retrieval: int = 2, max_generation: int = 2, max_cycles: int = 3, faith: float = 0.70, relevance: float = 0.65) -> DataFrame:
    """One step of the correction automaton.

    state: retrieval, generation, total (attempts so far), response, consistent, faithfulness, relevance. Adds
    decision, strategy and the attempts after the step.
    """
    stop = (F.col("total") >= max_cycles) | ((F.col("retrieval") >= max_retrieval) & (F.col("generation") >= max_generation))
    failed = F.trim(F.coalesce("response", F.lit(""))) == ""
    low = (F.col("faithfulness") < faith) | (F.col("relevance") < relevance)
    decision = F.when(stop, "approved_with_warning").when(failed | ~F.col("consistent"), "retry_generation").when(low, "retry_retrieval").otherwise("approved")
    strategy = F.when(decision == "retry_retrieval", F.when(F.col("retrieval") == 0, "domain_dictionary").when(F.col("retrieval") == 1, "pseudo_relevance_feedback").otherwise("llm_query_rewriter"))
    bump = lambda c, on: (F.col(c) + F.when(on, 1).otherwise(0)).alias(c)
    again = decision.isin("retry_generation", "retry_retrieval")
    rest = [c for c in state.columns if c not in ("retrieval", "generation", "total", "decision", "strategy")]
    return state.select(*rest, bump("retrieval", decision == "retry_retrieval"), bump("generation", decision == "retry_generation"), bump("total", again), decision.alias("decision"), strategy.alias("strategy"))


def simulate(state: DataFrame, cycles: int = 3, gain: float = 0.1) -> DataFrame:
    """Up to cycles + 1 steps; each retry raises the scores by gain. Adds the number of steps until approval or warning."""
    state = state.withColumns({"decision": F.lit(None).cast("string"), "strategy": F.lit(None).cast("string"), "steps": F.lit(0)})
    for _ in range(cycles + 1):
        open_ = F.coalesce(~F.col("decision").isin("approved", "approved_with_warning"), F.lit(True))
        held, more = state.where(~open_), decide(state.where(open_))
        raised = F.when(F.col("decision").isin("retry_generation", "retry_retrieval"), gain).otherwise(0.0)
        more = more.withColumns({"steps": F.col("steps") + 1, "faithfulness": F.col("faithfulness") + raised, "relevance": F.col("relevance") + raised, "consistent": F.col("consistent") | (F.col("decision") == "retry_generation")})
        state = held.unionByName(more)
    return state


def confusion(scored: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn with precision, recall, f1, f05, fpr and accuracy per group."""
    counts = scored.groupBy(*by).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    return counts.withColumns({"precision": p, "recall": r, "f1": part(2 * p * r, p + r), "f05": part(1.25 * p * r, 0.25 * p + r), "fpr": part(fp, fp + tn), "accuracy": part(tp + tn, tp + fp + fn + tn)})


def threshold_grid(scored: DataFrame, first: list[float], second: list[float], truth: Column, a: Column, b: Column, penalty: float = 1.5, top: int = 5) -> DataFrame:
    """Confusion for every pair of thresholds (flag if a or b lies under its own), the best by f1 - penalty * fpr.

    The grid is an exploded constant; its rows meet in map-side sums, so the cost is one pass of the scores.
    """
    grid = F.array(*(F.struct(F.lit(x).alias("first"), F.lit(y).alias("second")) for x in first for y in second))
    each = scored.select(truth.alias("truth"), a.alias("a"), b.alias("b"), F.inline(grid))
    m = confusion(each, ["first", "second"], F.col("truth"), (F.col("a") < F.col("first")) | (F.col("b") < F.col("second")))
    return m.withColumn("utility", F.col("f1") - penalty * F.col("fpr")).orderBy(F.desc(F.round("utility", 9)), "first", "second").limit(top)


def sessions(messages: DataFrame, top: int = 50) -> DataFrame:
    """The most recent sessions: conv_id, messages, last turn and the start of the first user message."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.substring(first, 1, 50).alias("preview")).orderBy(F.desc("conv_id")).limit(top)


def domain_terms(labelled: DataFrame, least: int = 3, critical: float = 3.841458820694124) -> DataFrame:
    """Terms (of at least three characters, in `least` texts) whose counts depend on a 0/1 label: term, chi2, n.

    labelled: id, label, terms (array). Chi-squared of the class sums of term counts, one degree of freedom;
    the critical value is that of p = 0.05.
    """
    # terms are counted inside their text, so that nothing is dealt out by text and term
    each = labelled.select("label", F.inline(term_counts(F.col("terms")))).where(F.length("term") >= 3)
    counts = each.groupBy("term").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("n1")).where(F.col("texts") >= least).where(~F.col("term").isin(STOP_WORDS))
    share = labelled.agg(F.avg(F.col("label").cast("double")).alias("p"))
    e1 = F.col("n") * F.col("p")
    chi = (F.col("n1") - e1) ** 2 / e1 + (F.col("n") - F.col("n1") - (F.col("n") - e1)) ** 2 / (F.col("n") - e1)
    return counts.crossJoin(F.broadcast(share)).select("term", chi.alias("chi2"), "n").where(F.col("chi2") > critical)  # one row of shares


def feedback_terms(chunks: DataFrame, top: int = 3, guard: float = 0.40) -> DataFrame:
    """Pseudo relevance feedback: per query the most frequent terms of its three best chunks, if the best scores at least guard.

    chunks: query_id, rank, score, text. Terms have three or more letters, digits, hyphens or underscores, count
    by case, and tie by first occurrence.
    """
    best = chunks.where("rank <= 3")
    best = best.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).where(F.col("top") >= guard)
    words = best.select("query_id", "rank", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9İıŞşĞğÜüÇçÖö_-]{3,}"), F.lit(0))).alias("at", "term"))
    kept = words.where(~F.lower("term").isin(STOP_WORDS) & ~F.col("term").rlike("^[0-9]+$"))
    counts = kept.groupBy("query_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "at")).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "first"))).where(F.col("place") <= top).drop("first")
