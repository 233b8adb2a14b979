"""Schemas of the stored tables and of the log lines that the sources read."""

from __future__ import annotations

TOKENS = "struct<input:bigint,output:bigint,cache_creation:bigint,cache_read:bigint,reasoning:bigint>"

EVENTS = (
    "source_event_id string, seq bigint, ts string, kind string, agent string, provider string, model string, session_id string, actor_id string,"
    " turn_index bigint, parent_event_id string, cwd string, git struct<remote_url:string,remote_host:string,remote_slug:string,branch:string,slug_source:string>,"
    f" tokens {TOKENS}, tokens_unmapped map<string,bigint>, duration_ms bigint, tool_calls map<string,bigint>, files_touched array<string>, tool_paths array<string>,"
    " content_excerpt string, content_bytes bigint, source_file string, source_byte_offset bigint, redactions map<string,bigint>"
)
SDK_EVENT = f"source_event_id string, session_id string, ts string, kind string, provider string, model string, content_excerpt string, tokens {TOKENS}, metadata map<string,string>"
SDK_CALL = "external_call_id string, source_event_id string, name string, status string, args string"
SDK_BATCH = f"events array<struct<{SDK_EVENT.replace(' string', ':string').replace(' struct', ':struct').replace(' map', ':map').replace(', ', ',')}>>, tool_calls array<struct<{SDK_CALL.replace(' string', ':string').replace(', ', ',')}>>"

BLOCK_LINE = (
    "type string, uuid string, parentUuid string, sessionId string, timestamp string, cwd string, gitBranch string, agentId string,"
    " message struct<role:string,model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>"
)
BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean,content:string>>"
USAGE = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>"
ROLLOUT_LINE = (
    "timestamp string, type string, payload struct<type:string,id:string,call_id:string,name:string,arguments:string,output:string,cwd:string,model:string,"
    f"message:string,text:string,status:string,info:struct<last_token_usage:{USAGE},total_token_usage:{USAGE}>>"
)
TREE_LINE = (
    "type string, id string, parentId string, timestamp string, cwd string, provider string, modelId string,"
    " message struct<role:string,content:string,toolCallId:string,isError:boolean,usage:struct<input:bigint,output:bigint,cacheWrite:bigint,cacheRead:bigint,reasoningTokens:bigint>>"
)
RECORD_LINE = (
    "id string, record_type string, payload_type string, stream struct<kind:string,id:string>, sequence bigint, recorded_at bigint,"
    " payload struct<kind:string,text:string,event:struct<kind:string,text:string>,usage:struct<input_tokens:bigint,output_tokens:bigint,cached_tokens:bigint,cache_write_tokens:bigint,reasoning_tokens:bigint>>"
)
BUBBLES = "composer_id string, bubble_id string, type bigint, text string, created_at string"
INVENTORY = "kind string, agent string, path string, config_dir string, detected_via array<string>, version string, provider string, account string, handle string, seen_at string"
