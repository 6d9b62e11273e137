"""Explicit schemas of the record types, as DDL."""

from __future__ import annotations

FACT = "fact_id string, fact string, source_doc string, source_url string, source_type string, document_id string, entity string, industry string, metric string, value_text string, value_number double, value_type string, unit string, currency string, scale string, date string, published_at string, retrieved_at string, raw_content_hash string, structured boolean"
REWARD = "struct<answer_correctness:double,answer_cem:double,format_compliance:double,search_incentive:double,retrieval_correctness:double,total:double,terminated_with_zero:boolean>"
AUDIT = f"qid string, prompt string, selected_target string, accepted_targets array<string>, assistant_trace string, final_answer string, num_rounds int, is_repeated_query boolean, searches array<struct<query:string,retrieved_characters:int,retrieved_preview:string,retrieved_record_count:int>>, reward {REWARD}"
STEP = "struct<query:string,retrieved_text:string,retrieved_records:array<struct<value_text:string,fact:string,unit:string>>>"
TRAJECTORY = f"qid string, prompt string, targets array<string>, raw_text string, search_steps array<{STEP}>, final_answer string, num_rounds int, tool_calls_in_single_round int, is_repeated_query boolean, valid_inst boolean"
QA = "prompt string, source string, qid string, ground_truth struct<target:array<string>,valid_inst:boolean>, meta struct<root_entity:string,hop_count:int,actions:array<string>,target_fact_id:string,target_policy:string,question_policy:string,involved_records:array<struct<fact_id:string,entity:string,metric:string,date:string,value_text:string>>>"
CACHE = "key string, created_at timestamp, text string, metadata string"
