"""Tagged agent traces: parsing of turns, searches and answers, loss masks, token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.text import trim, truthy

# The tags of a trace, the end marker of a chat turn.
TAGS = ("think", "search", "answer")
CHAT_END = "<|im_end|>"


def tag_contents(trace: Column, tag: str) -> Column:
    """What stands between each pair of tags.

    Each closing tag ends a piece, in which the first opening tag counts: one pass, also where tags stay open.
    """
    pieces = F.split(trace, f"</{tag}>", -1)
    closed = F.filter(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(f"<{tag}>")))
    return F.transform(closed, lambda x: F.substring(x, F.instr(x, f"<{tag}>") + len(f"<{tag}>"), F.length(x)))


def count_of(trace: Column, part: str) -> Column:
    """How often a text has a part."""
    return ((F.length(trace) - F.length(F.replace(trace, F.lit(part), F.lit("")))) / len(part)).cast("int")


def format_valid(trace: Column) -> Column:
    """Equal numbers of opening and closing tags, a think, a search or an answer, and no blank last answer.

    Order and nesting of the tags don't matter.
    """
    opened, closed = ({t: count_of(trace, f"<{s}{t}>") for t in TAGS} for s in ("", "/"))
    balanced = opened["think"] == closed["think"]
    for t in TAGS[1:]:
        balanced = balanced & (opened[t] == closed[t])
    answers = tag_contents(trace, "answer")
    last = trim(F.try_element_at(answers, F.lit(-1)))
    return balanced & (opened["think"] > 0) & ((opened["search"] > 0) | (opened["answer"] > 0)) & ((opened["answer"] == 0) | F.coalesce(last != "", F.lit(False)))


def parse_turn(turn: Column) -> Column:
    """struct(kind, content, thought, valid) of one turn: a think and then one search or one answer, nothing else.

    An invalid turn has null parts.
    """
    pattern = r"(?sU)^\s*<think>([^<]*)</think>\s*(?:<search>([^<]*)</search>|<answer>([^<]*)</answer>)\s*$"
    part = lambda i: trim(F.regexp_extract(turn, pattern, i))
    thought, query, answer = part(1), part(2), part(3)
    valid = F.coalesce((thought != "") & ((query != "") | (answer != "")), F.lit(False))
    kind = F.when(query != "", "search").otherwise("answer")
    content = F.when(query != "", query).otherwise(answer)
    return F.struct(F.when(valid, kind).alias("kind"), F.when(valid, content).alias("content"), F.when(valid, thought).alias("thought"), valid.alias("valid"))


def final_answer(trace: Column, mode: str = "closed") -> Column:
    """The answer of a trace.

    ``closed``: the last closed pair, null if blank.  ``keep_blank``: the same, but blank stays an empty text.
    ``last_open``: from the last opening tag to the last closing one after it, null if blank.
    """
    if mode == "last_open":
        after = F.substring_index(trace, "</answer>", -1)
        head = F.when(F.contains(trace, F.lit("</answer>")), F.substring(trace, F.lit(1), F.length(trace) - F.length(after) - len("</answer>")))
        return F.nullif(trim(F.when(F.contains(head, F.lit("<answer>")), F.substring_index(head, "<answer>", -1))), F.lit(""))
    last = trim(F.try_element_at(tag_contents(trace, "answer"), F.lit(-1)))
    return last if mode == "keep_blank" else F.nullif(last, F.lit(""))


def queries_of(trace: Column) -> Column:
    """All searches of a trace, trimmed."""
    return F.transform(tag_contents(trace, "search"), trim)


def has_repeat(queries: Column, fold: bool = False) -> Column:
    """Whether a query occurs twice; ``fold`` ignores case."""
    each = F.transform(queries, F.lower) if fold else queries
    return F.size(F.array_distinct(each)) < F.size(each)


def first_repeat(queries: Column, fold: bool = True) -> Column:
    """Zero-based position of the first query that occurred before, null if none."""
    each = F.transform(queries, F.lower) if fold else queries
    return F.array_min(F.filter(F.transform(each, lambda q, i: F.when(F.array_position(each, q) - 1 < i, i)), lambda i: i.isNotNull()))


def distinct_searches(queries: Column) -> Column:
    """How many different queries that aren't blank."""
    return F.size(F.array_distinct(F.filter(F.transform(queries, trim), truthy)))


def segment_spans(segments: Column) -> Column:
    """array<struct<start, end, mask>> of segments (owner, text) laid end to end; mask 1 where the assistant wrote."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,mask:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"), F.when(s["owner"] == "assistant", 1).otherwise(0).alias("mask"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(segments, zero, step, lambda acc: acc["spans"])


def env_mask(segments: Column, offsets: Column) -> Column:
    """A mask per token offset (start, end): its segment's.  Null where a token has no width or crosses a border."""
    spans = segment_spans(segments)

    def mask(token: Column) -> Column:
        owners = F.array_distinct(F.transform(F.filter(spans, lambda s: (token["start"] >= s["start"]) & (token["end"] <= s["end"])), lambda s: s["mask"]))
        return F.when((token["start"] < token["end"]) & (F.size(owners) == 1), owners[0])

    masks = F.transform(offsets, mask)
    return F.when(F.forall(masks, lambda m: m.isNotNull()), masks)


def character_offsets(text: Column) -> Column:
    """Offsets of a tokenizer that makes a token of each character."""
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.struct((i - 1).alias("start"), i.alias("end")))
    return F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def sampled_logprobs(ids: Column, candidates: Column) -> Column:
    """The log probability of each sampled id in its map of candidates; null if any is missing or the lengths differ."""
    picked = F.zip_with(ids, candidates, lambda i, m: F.try_element_at(m, i))
    return F.when((F.size(ids) == F.size(candidates)) & F.forall(picked, lambda v: v.isNotNull()), picked)


def strip_chat_end(text: Column, ids: Column, logprobs: Column, end_id: int, marker: str = CHAT_END) -> Column:
    """struct(text, ids, logprobs) without the marker that ends the text and the id that ends the ids."""
    ends = F.endswith(text, F.lit(marker))
    bare = F.when(ends, F.substring(text, F.lit(1), F.length(text) - len(marker))).otherwise(text)
    closing = F.coalesce(F.try_element_at(ids, F.lit(-1)) == end_id, F.lit(False)) & ends
    n = F.when(closing, F.size(ids) - 1).otherwise(F.size(ids))
    return F.struct(bare.alias("text"), F.slice(ids, F.lit(1), n).alias("ids"), F.slice(logprobs, F.lit(1), n).alias("logprobs"))


def chat_prompt(user: Column, system: str | None = None) -> Column:
    """A chat prompt that ends where the assistant begins."""
    head = [F.lit(f"<|im_start|>system\n{system}{CHAT_END}\n")] if system else []
    return F.concat(*head, F.lit("<|im_start|>user\n"), user, F.lit(f"{CHAT_END}\n<|im_start|>assistant\n"))


def observation_bridge(observation: Column) -> Column:
    """What goes between two assistant turns: the observation as a user's turn."""
    return F.concat(F.lit(f"{CHAT_END}\n<|im_start|>user\n"), observation, F.lit(f"{CHAT_END}\n<|im_start|>assistant\n"))


def completion_lists(parts: Column) -> Column:
    """struct(ids, mask, logprobs) of parts (owner, ids, logprobs) in order; what the environment wrote has zeros."""
    own = lambda p: F.when(p["owner"] == "assistant", 1).otherwise(0)
    return F.struct(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"),
        F.flatten(F.transform(parts, lambda p: F.transform(p["ids"], lambda _: own(p)))).alias("mask"),
        F.flatten(F.transform(parts, lambda p: F.when(own(p) == 1, p["logprobs"]).otherwise(F.transform(p["ids"], lambda _: F.lit(0.0))))).alias("logprobs"),
    )
