"""The public names in one place."""

from tallyloom.errors import ConfigError, DatasetError, RecordError, RetrievalError, SynthesisError, TallyloomError
from tallyloom.functions.keys import dedup_key, fact_split, label_split, short_hash
from tallyloom.functions.rewards import Weights, answer_f1, best_breakdown, breakdown, leaks_answer, too_easy
from tallyloom.functions.traces import completion_lists, env_mask, final_answer, format_valid, parse_turn
from tallyloom.functions.values import answer_targets, parse_answer_value, parse_value, quarter_label, value_type
from tallyloom.operators.audit import audit_rows, health_summary, markdown_report, report_metrics, reward_metrics
from tallyloom.operators.dedup import drop_conflicts, keep_first, keep_last, keep_longest, union_in_order
from tallyloom.operators.dimensions import companies, enrich_industry, infer_industry, name_in_title
from tallyloom.operators.facts import abstract_facts, announcement_facts, build_facts, passage_facts, question_facts, question_labels, recent_announcements, report_facts, requested_announcements
from tallyloom.operators.retrieval import format_evidence, format_facts, format_results, rank_hits, replay, retrieve, sample_facts, search, write_cache
from tallyloom.operators.rollout import replay_turns, trajectories, with_metadata
from tallyloom.operators.synthesis import lookup_question, number_rows, pair_facts, primary_target, render_candidates, render_facts, round_robin_roots, target_counts, training_row
from tallyloom.operators.validation import alignment_reason, audit_relations, dataset_gate, parse_records, parse_samples, validate_facts, without_findings
from tallyloom.operators.web import page_text, result_links, visible_text
from tallyloom.sources.jsonl import read_audit, read_fail_fast, read_lenient, read_quarantine, read_samples, read_strict, read_variant, write, write_decided, write_splits
from tallyloom.sources.protocols import RUNS, Encoder, RunConfig, SearchProvider, TextFunction, apply_text, choose, encode, read_config, retry
from tallyloom.sources.snapshot import load_records, read_snapshot, write_snapshot

__all__ = [name for name in dir() if not name.startswith("_")]
