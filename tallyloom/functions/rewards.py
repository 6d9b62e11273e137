"""Scores of search-agent trajectories as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import let, numbers, tokens
from tallyloom.functions.traces import distinct_searches, format_valid

# Words of answers that answer nothing.
INVALID_ANSWERS = (
    "无效", "问题无效", "无法回答", "没有答案", "题目有问题", "无效问题", "不能回答", "无答案", "题目无效", "问题有误", "文中未提及", "信息不足",
    "无法确定", "无法得知", "没有提供", "不能进行网络搜索", "无法访问", "不具备搜索能力", "我不知道", "没有找到", "未提及", "无法获知", "无法搜索",
    "invalid", "question is invalid", "no answer", "cannot answer", "unable to answer", "not answerable", "no valid answer", "not mentioned",
    "not provided", "insufficient information", "unable to determine", "it is not possible", "information is not available", "i cannot search",
    "i do not have access", "cannot be determined", "i don't know", "i do not know", "no information",
)


PARTS = ("answer_correctness", "answer_cem", "format_compliance", "search_incentive", "retrieval_correctness")


@dataclass(frozen=True)
class Weights:
    """The weights of the five parts, and the limits of each."""

    correctness: float = 0.4
    cem: float = 0.2
    format: float = 0.2
    retrieval: float = 0.1
    search: float = 0.05
    searches: int = 2
    tolerance: float = 0.05
    invalid: float = -0.5
    correct_f1: float = 0.3
    rounds: int = 25
    calls: int = 5


def numeric_score(pred: Column, truth: Column, w: Weights = Weights()) -> Column:
    """1 to 0.8 by the least relative error within the tolerance over all pairs of numbers; null if no pair is."""
    errors = F.flatten(F.transform(F.filter(truth, lambda g: g != 0), lambda g: F.transform(pred, lambda p: F.abs(p - g) / F.abs(g))))
    return 1.0 - 0.2 * (F.array_min(F.filter(errors, lambda e: e <= w.tolerance)) / w.tolerance)


def token_f1(pred: Column, truth: Column) -> Column:
    """F1 of token lists: the overlap is of sets, precision and recall are over list lengths."""
    both, n, m = F.size(F.array_intersect(pred, truth)), F.size(pred), F.size(truth)
    precision, recall = both / n, both / m
    return F.when((n > 0) & (m > 0) & (both > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)


def _f1(a: Column, x: Column, b: Column, y: Column, w: Weights) -> Column:
    """Of an answer's tokens and numbers (a, x) and a truth's (b, y)."""
    score = F.greatest(token_f1(a, b), F.coalesce(numeric_score(x, y, w), F.lit(0.0)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), score).otherwise(0.0)


def answer_f1(pred: Column, truth: Column, w: Weights = Weights()) -> Column:
    """The larger of token F1 and numeric score; 0 where a side has no token."""
    parts = F.struct(tokens(pred).alias("a"), numbers(pred).alias("x"), tokens(truth).alias("b"), numbers(truth).alias("y"))
    return let(parts, lambda p: _f1(p["a"], p["x"], p["b"], p["y"], w))


def is_invalid_answer(answer: Column, words: tuple[str, ...] = INVALID_ANSWERS) -> Column:
    """Whether an answer has one of the words that answer nothing, in any case."""
    return F.coalesce(F.lower(answer).rlike("|".join(re.escape(x) for x in words)), F.lit(False))


def correctness(answer: Column, truth: Column, valid: Column, w: Weights = Weights()) -> Column:
    return F.when(answer.isNull(), 0.0).when(valid & is_invalid_answer(answer), w.invalid).otherwise(w.correctness * answer_f1(answer, truth, w))


def cem(answer: Column, truth: Column, w: Weights = Weights()) -> Column:
    """Whether all tokens of the truth occur in the answer; a truth without tokens always does."""
    return F.when(answer.isNotNull() & F.forall(tokens(truth), lambda t: F.contains(answer, t)), w.cem).otherwise(0.0)


def search_incentive(queries: Column, w: Weights = Weights()) -> Column:
    return F.least(distinct_searches(queries), F.lit(w.searches)) * w.search


def retrieval_hit(steps: Column, truth: Column) -> Column:
    """Whether a step found the truth: in a record of a fitting unit by number, in a record by tokens, or in its text.

    ``steps`` are structs (query, retrieved_text, retrieved_records of (value_text, fact, unit)).
    """
    return let(F.struct(tokens(truth).alias("want"), numbers(truth).alias("digits"), F.contains(truth, F.lit("%")).alias("percent")), lambda t: _hit(steps, t["want"], t["digits"], t["percent"]))


def _hit(steps: Column, want: Column, digits: Column, percent: Column) -> Column:
    some = F.size(want) > 0
    near = lambda x: numeric_score(numbers(x), digits).isNotNull()
    safe = lambda x: F.coalesce(x, F.lit(""))

    def record(r: Column) -> Column:
        value, fact, unit = safe(r["value_text"]), safe(r["fact"]), safe(r["unit"])
        fits = ~percent | F.contains(F.concat(value, unit), F.lit("%"))
        return (some & F.forall(want, lambda t: F.contains(value, t) | F.contains(fact, t))) | (fits & (near(value) | near(fact)))

    def step(s: Column) -> Column:
        text = safe(s["retrieved_text"])
        return F.exists(s["retrieved_records"], record) | (some & F.forall(want, lambda t: F.contains(text, t))) | near(text)

    return F.coalesce(F.exists(steps, step), F.lit(False))


def terminated(trace: Column, answer: Column, rounds: Column, calls: Column, repeated: Column, w: Weights = Weights()) -> Column:
    """No answer, too many rounds or calls, a repeated query or a bad format: nothing is scored."""
    return answer.isNull() | (rounds > w.rounds) | (calls > w.calls) | repeated | ~format_valid(trace)


def breakdown(trace: Column, answer: Column, truth: Column, steps: Column, rounds: Column, calls: Column, repeated: Column, valid: Column, w: Weights = Weights()) -> Column:
    """struct of the five parts, their sum within 0 to 1, and whether the trajectory was terminated with zero.

    What is needed more than once is bound first, so that no pattern runs twice.
    """
    own = _own_parts(trace, answer, steps, rounds, calls, repeated, valid, w)
    return let(own, lambda o: _scored(o, answer, truth, steps, w))


def _own_parts(trace: Column, answer: Column, steps: Column, rounds: Column, calls: Column, repeated: Column, valid: Column, w: Weights) -> Column:
    """What doesn't depend on the truth."""
    whole = answer.isNull() | (rounds > w.rounds) | (calls > w.calls) | repeated
    return let(
        format_valid(trace),
        lambda fine: F.struct(
            fine.alias("fine"), (whole | ~fine).alias("zero"), (valid & is_invalid_answer(answer)).alias("invalid"), tokens(answer).alias("a"), numbers(answer).alias("x"),
            search_incentive(F.transform(steps, lambda s: s["query"]), w).alias("search"),
        ),
    )


def _scored(o: Column, answer: Column, truth: Column, steps: Column, w: Weights) -> Column:
    wanted = F.struct(tokens(truth).alias("b"), numbers(truth).alias("y"), F.contains(truth, F.lit("%")).alias("percent"))

    def parts(t: Column) -> Column:
        right = F.when(answer.isNull(), 0.0).when(o["invalid"], w.invalid).otherwise(w.correctness * _f1(o["a"], o["x"], t["b"], t["y"], w))
        covers = answer.isNotNull() & F.forall(t["b"], lambda x: F.contains(answer, x))
        return F.struct(
            right.alias("answer_correctness"), F.when(covers, w.cem).otherwise(0.0).alias("answer_cem"), F.when(o["fine"], w.format).otherwise(0.0).alias("format_compliance"),
            o["search"].alias("search_incentive"), F.when(_hit(steps, t["b"], t["y"], t["percent"]), w.retrieval).otherwise(0.0).alias("retrieval_correctness"),
        )

    def summed(p: Column) -> Column:
        total = p[PARTS[0]]
        for name in PARTS[1:]:  # in this order: sums of doubles depend on it
            total = total + p[name]
        return F.struct(*[p[name].alias(name) for name in PARTS], F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)).alias("total"), F.lit(False).alias("terminated_with_zero"))

    nothing = F.struct(*[F.lit(0.0).alias(name) for name in (*PARTS, "total")], F.lit(True).alias("terminated_with_zero"))
    return F.when(o["zero"], nothing).otherwise(let(let(wanted, parts), summed))


def best_breakdown(targets: Column, **parts: Column) -> Column:
    """struct(target, reward) of the accepted target with the largest total; of equal ones the first."""
    w = parts.pop("w", Weights())
    own = _own_parts(*(parts[c] for c in ("trace", "answer", "steps", "rounds", "calls", "repeated", "valid")), w)

    def best(o: Column) -> Column:
        return let(F.transform(targets, lambda t: F.struct(_scored(o, parts["answer"], t, parts["steps"], w).alias("reward"), t.alias("target"))), pick)

    def pick(scored: Column) -> Column:
        found = F.aggregate(scored, F.try_element_at(scored, F.lit(1)), lambda a, b: F.when(b["reward"]["total"] > a["reward"]["total"], b).otherwise(a))
        return let(found, lambda x: F.struct(x["target"].alias("target"), x["reward"].alias("reward")))

    return let(own, best)


def too_easy(guesses: Column, targets: Column, w: Weights = Weights()) -> Column:
    """Whether a guess without search is right for some target: such questions are rejected."""
    return F.exists(guesses, lambda g: F.exists(targets, lambda t: answer_f1(g, t, w) >= w.correct_f1))


def leaks_answer(question: Column, targets: Column) -> Column:
    """Whether a target of two or more characters stands in the question, spaces aside."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    return F.exists(targets, lambda t: (F.length(bare(t)) >= 2) & F.contains(bare(question), bare(t)))
