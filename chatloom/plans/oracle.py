"""DuckDB SQL with the same results as the queries of the same name."""

from __future__ import annotations

from chatloom.plans.queries import CFG, EVENT_GAP, EVENT_MAX, EVENT_MIN, RUN_ID

MIN, MAX = CFG.token_limits


# The oracle states the rules on its own and takes none from the engine.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\r]"
BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
ISO_DATE = (
    "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    "([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))::BIGINT"


def normal(text: str) -> str:
    return f"replace(trim({text}, {lit(BLANKS)}), chr(10), ' ')"


def secs(ts: str) -> str:
    return f"floor(epoch({ts}))::BIGINT"


def with_ctes(select: str, *ctes: str, recursive: bool = False) -> str:
    kind = "WITH RECURSIVE" if recursive else "WITH"
    return f"{kind} " + ",\n".join(ctes) + "\n" + select


# Adapters -------------------------------------------------------------------

RAW = """
lines AS (
  SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS body,
         unnest(range(len(string_split(text, chr(10))))) AS line
  FROM conversations),
chat_raw AS (
  SELECT conv_id AS chat_key,
         CASE WHEN conv_id % 10 <> 8 THEN 'contact_' || conv_id END AS name,
         CASE WHEN conv_id % 10 = 9 THEN 'private_group' ELSE 'personal_chat' END AS type,
         turn * 10000 + line AS pos,
         CASE role WHEN 'assistant' THEN 'Me' WHEN 'user' THEN 'contact_' || conv_id END AS sender,
         TIMESTAMP '2024-01-01' + to_seconds(conv_id * 86400 + turn * 3000 + line
           + CASE WHEN turn >= 4 THEN 7200 ELSE 0 END) AS sent,
         body || CASE WHEN conv_id % 7 = 3 AND line = 0 THEN '🙂' ELSE '' END AS body,
         (conv_id % 7 = 3 AND line = 0) AS has_sticker
  FROM lines)"""

DATE = "strftime(sent, '%Y-%m-%dT%H:%M:%S')"

DIRTY = f"""
dirty AS (
  SELECT chat_key, name, type, pos, sender, has_sticker,
         CASE (chat_key + pos) % 7
           WHEN 1 THEN left({DATE}, 10) WHEN 2 THEN {DATE} || '+02:00'
           WHEN 3 THEN 'not a date' WHEN 4 THEN left({DATE}, 7) ELSE {DATE} END AS date,
         (chat_key + pos) % 11 AS pick,
         CASE (chat_key + pos) % 11
           WHEN 5 THEN '  ' || chr(160) || chr(10) || CASE WHEN has_sticker THEN '🙂' ELSE '' END
           WHEN 6 THEN CASE WHEN has_sticker THEN '🙂' ELSE '' END
           WHEN 7 THEN CASE WHEN has_sticker THEN '🙂' ELSE '' END
           ELSE body END AS body
  FROM chat_raw),
parsed AS (
  SELECT *, CASE WHEN regexp_matches(date, '{ISO_DATE}')
                 THEN try_cast(left(date, 19) AS TIMESTAMP) END AS ts,
         {normal('body')} AS content
  FROM dirty)"""

USABLE = f"""
usable AS (
  SELECT chat_key, name, type, pos, sent AS ts,
         CASE WHEN sender = 'Me' THEN 'assistant' ELSE 'user' END AS role,
         {normal('body')} AS content, {tokens(normal('body'))} AS n_tokens
  FROM chat_raw
  WHERE name IS NOT NULL AND type = 'personal_chat' AND sender IS NOT NULL
    AND length({normal('body')}) > 0)"""

EVENTS = """
usable AS (
  SELECT user_id AS chat_key, event_id AS pos, ts, 1 + event_id % 7 AS n_tokens FROM events)"""

LEDGER = """
ledger AS (
  SELECT md5(event_id::VARCHAR) AS run_id,
         CASE WHEN event_id % 2 = 0 THEN 'data-prep' ELSE 'fine-tuning' END AS type,
         CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running'
           WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
         ts AS created_at, CASE WHEN event_type = 'error' THEN props END AS error
  FROM events)"""

GAPS = """
gaps AS (
  SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY chat_key ORDER BY ts, pos)))
            AS gap_us
  FROM usable)"""


def sessions(gap: int) -> str:
    return f"""
sessions AS (
  SELECT *, (sum(CASE WHEN gap_us <= {gap * 1_000_000} THEN 0 ELSE 1 END)
             OVER (PARTITION BY chat_key ORDER BY ts, pos) - 1)::BIGINT AS session
  FROM gaps)"""


def blocks(low: int, high: int) -> str:
    return f"""
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY chat_key, session ORDER BY ts, pos) AS rn
  FROM sessions),
fold AS (
  SELECT chat_key, session, rn, n_tokens AS held, pos AS block_start
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.chat_key, n.session, n.rn,
         CASE WHEN f.held + n.n_tokens <= {high} THEN f.held + n.n_tokens ELSE n.n_tokens END,
         CASE WHEN f.held + n.n_tokens <= {high} THEN f.block_start ELSE n.pos END
  FROM fold f JOIN numbered n
    ON n.chat_key = f.chat_key AND n.session = f.session AND n.rn = f.rn + 1),
members AS (
  SELECT n.*, f.block_start
  FROM numbered n JOIN fold f USING (chat_key, session, rn)),
blocks AS (
  SELECT chat_key, session, block_start, count(*) AS n_messages,
         sum(n_tokens)::BIGINT AS n_tokens,
         CASE WHEN sum(n_tokens) < {low} THEN 'short'
              WHEN sum(n_tokens) > {high} THEN 'long' ELSE 'kept' END AS verdict
  FROM members GROUP BY ALL)"""


RUNS = """
kept_members AS (
  SELECT m.*, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS opens
  FROM members m JOIN blocks b USING (chat_key, block_start)
  WHERE b.verdict = 'kept'
  WINDOW w AS (PARTITION BY chat_key, block_start ORDER BY m.ts, m.pos)),
role_runs AS (
  SELECT *, (sum(opens) OVER (PARTITION BY chat_key, block_start ORDER BY ts, pos) - 1)::BIGINT
            AS run_no
  FROM kept_members),
merged AS (
  SELECT chat_key, name, type, block_start, run_no AS turn_no, role,
         string_agg('>>> ' || content, chr(10) ORDER BY ts, pos) AS content, min(ts) AS ts
  FROM role_runs GROUP BY ALL)"""

TRIMMED = """
bounds AS (
  SELECT chat_key, block_start, min(turn_no) FILTER (role = 'user') AS first_user,
         max(turn_no) FILTER (role = 'assistant') AS last_reply
  FROM merged GROUP BY ALL),
trimmed AS (
  SELECT m.* REPLACE (m.turn_no - b.first_user AS turn_no)
  FROM merged m JOIN bounds b USING (chat_key, block_start)
  WHERE m.turn_no BETWEEN b.first_user AND b.last_reply)"""

PROMPT_TURNS = """
turns AS (
  SELECT chat_key, name, type, block_start, turn_no + 1 AS turn_no, role, content, ts FROM trimmed
  UNION ALL
  SELECT DISTINCT chat_key, name, type, block_start, 0, 'system', 'Answer as Me.', NULL::TIMESTAMP
  FROM merged)"""

PLAIN_TURNS = """
turns AS (SELECT * FROM trimmed)"""


def reviewed(fewest: int) -> str:
    return f"""
sizes AS (
  SELECT b.chat_key, b.block_start, any_value(b.name) AS name, any_value(b.type) AS type,
         count(t.role) AS n_turns,
         coalesce(sum({tokens('t.content')}), 0)::BIGINT AS n_tokens,
         min(t.ts) AS first_ts, max(t.ts) AS last_ts
  FROM (SELECT DISTINCT chat_key, name, type, block_start FROM merged) b
  LEFT JOIN turns t USING (chat_key, block_start)
  GROUP BY b.chat_key, b.block_start),
reviewed AS (
  SELECT *, CASE WHEN n_turns < {fewest} THEN 'few turns' WHEN n_tokens < {MIN} THEN 'short'
                 WHEN n_tokens > {MAX} THEN 'long' ELSE 'valid' END AS outcome
  FROM sizes),
valid AS (
  SELECT t.* FROM turns t JOIN reviewed r USING (chat_key, block_start)
  WHERE r.outcome = 'valid')"""


PASS_ONE = (RAW, USABLE, GAPS, sessions(CFG.gap_seconds), blocks(MIN, MAX))
MERGED = (*PASS_ONE, RUNS)
PLAIN = (*MERGED, TRIMMED, PLAIN_TURNS, reviewed(2))
PROMPTED = (*MERGED, TRIMMED, PROMPT_TURNS, reviewed(3))
BREAKDOWN = """
breakdown AS (
  SELECT name AS contact_name, arg_max(n, chat_key) AS num_blocks, min(chat_key) AS first_chat
  FROM (SELECT chat_key, name, count(*) FILTER (outcome = 'valid') AS n
        FROM reviewed GROUP BY ALL)
  GROUP BY name)"""


def from_raw(select: str) -> str:
    return with_ctes(select, RAW)


def from_dirty(select: str) -> str:
    return with_ctes(select, RAW, DIRTY)


def from_ledger(select: str) -> str:
    return with_ctes(select, LEDGER)


def folded(select: str, ctes: tuple[str, ...]) -> str:
    return with_ctes(select, *ctes, recursive=True)


EVENT_SESSIONS = (EVENTS, GAPS, sessions(EVENT_GAP))
BLOCK_COLUMNS = "chat_key, block_start, session, n_messages, n_tokens, verdict"
TURN_COLUMNS = f"chat_key, block_start, turn_no, role, content, {secs('ts')} AS ts"
LEDGER_COLUMNS = f"run_id, type, status, {secs('created_at')} AS created_at"

VIOLATION = """
  SELECT chat_key, block_start,
         CASE WHEN count({t}.role) = 0 THEN 'empty block'
              WHEN arg_min({t}.role, {t}.turn_no) <> 'user' THEN 'first turn is not user'
              WHEN arg_max({t}.role, {t}.turn_no) <> 'assistant' THEN 'last turn is not assistant'
              ELSE 'none' END AS {name}
  FROM (SELECT DISTINCT chat_key, block_start FROM merged) b
  LEFT JOIN {t} USING (chat_key, block_start) GROUP BY ALL"""

# Chat templates -------------------------------------------------------------

LLAMA_TURN = "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || content || '<|eot_id|>'"
CHATML_TURN = "'<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)"
GEMMA_TURN = """CASE WHEN role = 'system' THEN '' ELSE
  '<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10)
  || CASE WHEN turn_no = 1 THEN 'Answer as Me.' || chr(10) || chr(10) ELSE '' END
  || content || '<end_of_turn>' || chr(10) END"""
MISTRAL_TURN = """CASE role WHEN 'system' THEN ''
  WHEN 'user' THEN '[INST] '
    || CASE WHEN turn_no = 1 THEN 'Answer as Me.' || chr(10) || chr(10) ELSE '' END
    || content || ' [/INST]'
  ELSE ' ' || content || '</s>' END"""


def rendered(turn: str) -> str:
    return f"string_agg({turn}, '' ORDER BY turn_no)"


def marker_case(side: str) -> str:
    """Marker in front of the ``user`` or the ``assistant`` side of a template."""
    gemma = {"user": "user", "assistant": "model"}[side]
    head = f"'<|start_header_id|>{side}<|end_header_id|>'"
    return f"""CASE
      WHEN contains(template, 'chatml') THEN '<|im_start|>{side}' || chr(10)
      WHEN contains(template, 'llama-3-8b') OR contains(model, 'llama-3-8b') THEN {head}
      WHEN contains(template, 'llama') OR contains(model, 'llama')
        THEN {head} || chr(10) || chr(10)
      WHEN contains(template, 'gemma') OR contains(model, 'gemma')
        THEN '<start_of_turn>{gemma}' || chr(10)
      ELSE 'none' END"""


MODELS = """
choices AS (
  SELECT event_id,
         CASE event_id % 6
           WHEN 0 THEN 'unsloth/Meta-Llama-3.1-8B-Instruct-unsloth-bnb-4bit'
           WHEN 1 THEN 'unsloth/Llama-3.2-3B-Instruct-unsloth-bnb-4bit'
           WHEN 2 THEN 'unsloth/llama-3-8b-Instruct-bnb-4bit'
           WHEN 3 THEN 'tests/small-gemma-chat'
           WHEN 4 THEN 'tests/plain-chat'
           ELSE 'tests/tiny-llama-chat' END AS model,
         CASE event_id % 5 WHEN 0 THEN 'chatml' WHEN 1 THEN 'llama-3.2'
           WHEN 2 THEN 'gemma-3' ELSE 'mistral' END AS template
  FROM events)"""

ASK = "<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || '"
ANSWER = "<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || '"

# The text of a block alternates: prompt up to and with the reply header, reply
# with its end mark, and so on. Span 2k is prompt k, span 2k+1 is reply k.
SPANS = f"""
  SELECT chat_key, block_start, turn_no AS span,
         CASE WHEN role = 'user' THEN
           CASE WHEN turn_no = 0 THEN '<|begin_of_text|>' ELSE '' END
           || '{ASK}' || content || '<|eot_id|>' || '{ANSWER}'
         ELSE content || '<|eot_id|>' END AS text,
         role = 'assistant' AS is_target
  FROM valid"""

# Exported documents ---------------------------------------------------------

DOCS = """
docs AS (
  SELECT conv_id // 5 AS doc, count(DISTINCT conv_id) AS n_chats
  FROM conversations GROUP BY ALL),
verdicts AS (
  SELECT doc, CASE doc % 4 WHEN 3 THEN 'unparseable' WHEN 2 THEN 'no valid chats'
                ELSE 'ok' END AS status,
         CASE WHEN doc % 4 >= 2 THEN 0 ELSE n_chats END AS n_chats
  FROM docs)"""

CHAT_SIZES = """
chat_sizes AS (
  SELECT name, type, count(*) AS n_messages
  FROM chat_raw GROUP BY chat_key, name, type)"""

STATS = """
stats AS (
  SELECT count(DISTINCT chat_key) AS num_chats,
         count(*) FILTER (outcome = 'valid') AS num_blocks,
         min(n_tokens) FILTER (outcome = 'valid') AS min_tokens_per_block,
         max(n_tokens) FILTER (outcome = 'valid') AS max_tokens_per_block,
         (sum(n_tokens) FILTER (outcome = 'valid'))::DOUBLE
           / count(*) FILTER (outcome = 'valid') AS avg_tokens_per_block,
         min(epoch_us(last_ts) - epoch_us(first_ts)) FILTER (outcome = 'valid') / 6e7
           AS min_duration_minutes_per_block,
         max(epoch_us(last_ts) - epoch_us(first_ts)) FILTER (outcome = 'valid') / 6e7
           AS max_duration_minutes_per_block,
         (sum(epoch_us(last_ts) - epoch_us(first_ts)) FILTER (outcome = 'valid'))::DOUBLE
           / count(*) FILTER (outcome = 'valid') / 6e7 AS avg_duration_minutes_per_block
  FROM reviewed)"""

# The metadata of the run with default training parameters.
METADATA = {
    "uuid": RUN_ID,
    "model_id": "unsloth/Llama-3.2-3B-Instruct-bnb-4bit",
    "target_name": "Me",
    "system_prompt": "None",
    "date_limit": "None",
    "convo_block_threshold_secs": "3600",
    "min_tokens_per_block": "100",
    "max_tokens_per_block": "300",
    "message_delimiter": ">>>",
    "ft_model_name": "unsloth/Llama-3.2-3B-Instruct-bnb-4bit",
    "ft_max_seq_length": "2048",
    "ft_load_in_4bit": "True",
    "ft_chat_template": "llama-3.2",
    "ft_dataset_split": "train",
    "ft_dataset_num_proc": "2",
    "ft_lora_r": "16",
    "ft_lora_alpha": "16",
    "ft_lora_dropout": "0",
    "ft_lora_bias": "none",
    "ft_use_gradient_checkpointing": "unsloth",
    "ft_random_state": "3407",
    "ft_use_rslora": "False",
    "ft_target_modules": "['q_proj', 'k_proj', 'v_proj', 'o_proj', 'gate_proj', 'up_proj', 'down_proj']",
    "ft_batch_size": "2",
    "ft_gradient_accumulation_steps": "4",
    "ft_warmup_steps": "5",
    "ft_max_steps": "60",
    "ft_learning_rate": "0.0002",
    "ft_weight_decay": "0.01",
    "ft_lr_scheduler_type": "linear",
    "ft_seed": "3407",
    "ft_packing": "False",
}
STAT_NAMES = [
    "num_chats", "num_blocks", "min_tokens_per_block", "max_tokens_per_block",
    "avg_tokens_per_block", "min_duration_minutes_per_block",
    "max_duration_minutes_per_block", "avg_duration_minutes_per_block",
]
ENTRIES = (
    "entries AS (SELECT * FROM (VALUES "
    + ", ".join(f"({lit(k)}, {lit(v)})" for k, v in METADATA.items())
    + ") v(key, value)"
    + "".join(f" UNION ALL SELECT 'stats_{n}', {n}::VARCHAR FROM stats" for n in STAT_NAMES)
    + ")"
)
KIND = """CASE WHEN lower(value) IN ('true', 'false') THEN 'bool'
              WHEN regexp_matches(value, '^-?[0-9]+$') THEN 'int'
              WHEN regexp_matches(value, '^-?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN 'float'
              WHEN regexp_matches(value, '^\\[''.*\\]$') THEN 'list' ELSE 'str' END"""

SQL: dict[str, str] = {
    # Messages
    "flatten_messages": from_raw(f"""
  SELECT chat_key, row_number() OVER (PARTITION BY chat_key ORDER BY chat_raw.pos) - 1 AS pos,
         sender AS "from", {DATE} AS date, body FROM chat_raw"""),
    "message_text": from_raw("SELECT chat_key, pos, body FROM chat_raw"),
    "normalize_text": f"SELECT doc_id, {normal('text')} AS content FROM documents",
    "assign_role": from_raw("""
  SELECT chat_key, pos, CASE WHEN sender = 'Me' THEN 'assistant' ELSE 'user' END AS role
  FROM chat_raw"""),
    "parse_timestamp": from_dirty(
        f"SELECT chat_key, pos, date, {secs('ts')} AS ts FROM parsed"
    ),
    "effective_date_limit": f"""
  SELECT event_id, CASE WHEN d <= TIMESTAMP '2024-01-15' THEN {secs('d')} END AS date_limit
  FROM (SELECT event_id, CASE event_id % 5 WHEN 2 THEN date_trunc('second', ts)
                           WHEN 3 THEN date_trunc('day', ts)::TIMESTAMP END AS d FROM events)""",
    "token_count": f"SELECT doc_id, {tokens('text')} AS n_tokens FROM documents",
    "named_chats": from_raw(
        "SELECT chat_key, pos, name FROM chat_raw WHERE name IS NOT NULL"
    ),
    "chat_type_filter": from_raw(
        "SELECT chat_key, pos, type FROM chat_raw WHERE type = 'personal_chat'"
    ),
    "eligible_messages": from_dirty("""
  SELECT chat_key, pos, sender FROM dirty
  WHERE sender IS NOT NULL AND (pick <> 7 OR has_sticker)"""),
    "date_limit_filter": from_raw(f"""
  SELECT chat_key, pos, {secs('sent')} AS ts FROM chat_raw
  WHERE sent >= TIMESTAMP '2024-01-20 03:20:05'"""),
    "nonempty_content": from_dirty(
        "SELECT chat_key, pos, content FROM parsed WHERE length(content) > 0"
    ),
    "quarantine": from_dirty("""
  SELECT * FROM (
    SELECT chat_key, pos,
           CASE WHEN name IS NULL THEN 'chat without name'
                WHEN type <> 'personal_chat' THEN 'chat type'
                WHEN sender IS NULL THEN 'no sender'
                WHEN pick = 7 AND NOT has_sticker THEN 'no text or sticker'
                WHEN pick = 6 THEN 'entity without text'
                WHEN ts IS NULL THEN 'bad date'
                WHEN ts < TIMESTAMP '2024-01-20 03:20:05' THEN 'before date limit'
                WHEN length(content) = 0 THEN 'empty content' END AS reject_reason
    FROM parsed)
  WHERE reject_reason IS NOT NULL"""),
    "chronological": with_ctes(
        """SELECT chat_key, pos,
         row_number() OVER (PARTITION BY chat_key ORDER BY ts, pos) AS place FROM usable""",
        RAW, USABLE,
    ),
    # Sessions and blocks
    "message_gap": with_ctes(
        "SELECT chat_key, pos, gap_us / 1e6 AS gap_seconds FROM gaps", RAW, USABLE, GAPS
    ),
    "event_gap": with_ctes(
        "SELECT chat_key, pos, gap_us / 1e6 AS gap_seconds FROM gaps", EVENTS, GAPS
    ),
    "time_sessions": with_ctes(
        "SELECT chat_key, pos, session FROM sessions",
        RAW, USABLE, GAPS, sessions(CFG.gap_seconds),
    ),
    "event_sessions": with_ctes(
        """SELECT chat_key, session, count(*) AS n_messages, min(pos) AS first_pos,
         sum(n_tokens)::BIGINT AS n_tokens FROM sessions GROUP BY ALL""",
        *EVENT_SESSIONS,
    ),
    "token_blocks": folded(f"SELECT {BLOCK_COLUMNS} FROM blocks", PASS_ONE),
    "event_token_blocks": folded(
        f"SELECT {BLOCK_COLUMNS} FROM blocks",
        (*EVENT_SESSIONS, blocks(EVENT_MIN, EVENT_MAX)),
    ),
    "block_token_filter": folded(
        """SELECT chat_key, block_start, session, n_messages, n_tokens
         FROM blocks WHERE verdict = 'kept'""",
        PASS_ONE,
    ),
    "kept_chats": folded(
        """SELECT DISTINCT chat_key, name, type
         FROM members JOIN blocks USING (chat_key, block_start) WHERE verdict = 'kept'""",
        PASS_ONE,
    ),
    "role_runs": folded(
        "SELECT chat_key, block_start, run_no, pos, role FROM role_runs", MERGED
    ),
    "merge_runs": folded(f"SELECT {TURN_COLUMNS} FROM merged", MERGED),
    "trim_block_ends": folded(f"SELECT {TURN_COLUMNS} FROM trimmed", (*MERGED, TRIMMED)),
    "prepend_system": folded(f"SELECT {TURN_COLUMNS} FROM turns", PROMPTED),
    "final_token_filter": folded(
        "SELECT chat_key, block_start, n_turns, n_tokens, outcome FROM reviewed", PROMPTED
    ),
    "valid_blocks": folded(
        f"""SELECT * FROM ({VIOLATION.format(t='merged', name='before_trim')})
  JOIN ({VIOLATION.format(t='trimmed', name='after_trim')}) USING (chat_key, block_start)""",
        (*MERGED, TRIMMED),
    ),
    "train_blocks": folded(
        "SELECT chat_key, block_start, turn_no, role, content FROM valid", PLAIN
    ),
    "processed_chats": folded(
        f"""
  SELECT c.chat_key, c.contact_name, c.chat_type, c.num_blocks, b.block_no, v.turn_no,
         strftime(v.ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", v.role, v.content
  FROM (SELECT chat_key, name AS contact_name, type AS chat_type,
               count(*) FILTER (outcome = 'valid') AS num_blocks
        FROM reviewed GROUP BY ALL) c
  LEFT JOIN (SELECT chat_key, block_start,
                    row_number() OVER (PARTITION BY chat_key ORDER BY first_ts, block_start) - 1
                    AS block_no
             FROM reviewed WHERE outcome = 'valid') b USING (chat_key)
  LEFT JOIN valid v ON v.chat_key = b.chat_key AND v.block_start = b.block_start""",
        PLAIN,
    ),
    # Statistics
    "block_funnel": folded(
        """
  SELECT (SELECT count(DISTINCT chat_key) FROM usable) AS chats_built,
         (SELECT count(DISTINCT chat_key) FROM blocks WHERE verdict = 'kept') AS chats_kept,
         (SELECT count(DISTINCT chat_key) FROM usable)
           - (SELECT count(DISTINCT chat_key) FROM blocks WHERE verdict = 'kept')
           AS chats_discarded,
         (SELECT count(*) FROM blocks WHERE verdict = 'kept') AS raw_blocks,
         (SELECT count(*) FROM blocks WHERE verdict = 'short') AS short_blocks,
         (SELECT count(*) FROM blocks WHERE verdict = 'long') AS long_blocks,
         count(*) FILTER (outcome = 'few turns') AS few_turn_blocks,
         count(*) FILTER (outcome = 'short') AS short_merged_blocks,
         count(*) FILTER (outcome = 'long') AS long_merged_blocks,
         count(*) FILTER (outcome = 'valid') AS valid_blocks
  FROM reviewed""",
        PLAIN,
    ),
    "chat_stats": folded("SELECT * FROM stats", (*PLAIN, STATS)),
    "block_breakdown": folded("SELECT * FROM breakdown", (*PLAIN, BREAKDOWN)),
    "block_durations": folded(
        """SELECT chat_key, block_start,
         (epoch_us(last_ts) - epoch_us(first_ts)) / 6e7 AS duration_minutes
  FROM reviewed WHERE outcome = 'valid'""",
        PLAIN,
    ),
    "top_chats": folded(
        """SELECT *, row_number() OVER (ORDER BY num_blocks DESC, first_chat)::INTEGER AS rank
  FROM breakdown ORDER BY num_blocks DESC, first_chat LIMIT 10""",
        (*PLAIN, BREAKDOWN),
    ),
    "top_n_others": folded(
        """
  SELECT rank, contact_name, num_blocks,
         100.0 * num_blocks / (SELECT sum(num_blocks) FROM breakdown) AS share_percent
  FROM (SELECT rank, contact_name, num_blocks FROM ranked WHERE rank <= 10
        UNION ALL
        SELECT 11, 'Others', sum(num_blocks)::BIGINT FROM ranked WHERE rank > 10
        HAVING count(*) > 0)""",
        (
            *PLAIN, BREAKDOWN,
            """ranked AS (SELECT *,
         row_number() OVER (ORDER BY num_blocks DESC, first_chat)::INTEGER AS rank
       FROM breakdown)""",
        ),
    ),
    "sender_ranking": from_raw(f"""
  SELECT sender, count(*) AS n_messages, min(chat_key) AS chat_key,
         arg_min(pos, (chat_key, pos)) AS pos
  FROM (SELECT trim(sender, {lit(BLANKS)}) AS sender, chat_key, pos FROM chat_raw
        WHERE sender IS NOT NULL)
  GROUP BY sender"""),
    # Training text
    "standardize_roles": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "render_template": folded(
        f"""
  SELECT chat_key, block_start, {rendered(CHATML_TURN)} AS chatml,
         '<|begin_of_text|>' || {rendered(LLAMA_TURN)} AS llama_3_2,
         '<bos>' || {rendered(GEMMA_TURN)} AS gemma_3,
         '<s>' || {rendered(MISTRAL_TURN)} AS mistral
  FROM valid GROUP BY ALL""",
        PROMPTED,
    ),
    "render_prompt": folded(
        f"""
  SELECT chat_key, block_start,
         '<|begin_of_text|>' || {rendered(LLAMA_TURN)}
         || '{ASK}>>> Really?<|eot_id|>{ANSWER}' AS prompt
  FROM valid GROUP BY ALL""",
        PLAIN,
    ),
    "response_markers": with_ctes(
        f"""SELECT event_id, {marker_case("user")} AS instruction_marker,
         {marker_case("assistant")} AS response_marker FROM choices""",
        MODELS,
    ),
    "model_template": with_ctes(
        """SELECT event_id, model, CASE model
         WHEN 'unsloth/Meta-Llama-3.1-8B-Instruct-unsloth-bnb-4bit' THEN 'llama-3.1'
         WHEN 'unsloth/Llama-3.2-3B-Instruct-unsloth-bnb-4bit' THEN 'llama-3.2'
         WHEN 'unsloth/llama-3-8b-Instruct-bnb-4bit' THEN 'llama-3' END AS chat_template
  FROM choices""",
        MODELS,
    ),
    "response_spans": folded(SPANS, PLAIN),
    "seq_length_check": f"""
  SELECT doc_id, n_text_tokens, n_text_tokens > 2048 AS over_limit
  FROM (SELECT doc_id, {tokens('text')} AS n_text_tokens FROM documents)""",
    "typed_metadata": f"""
  SELECT event_id, kind,
         CASE WHEN kind = 'bool' THEN lower(value) = 'true' END AS value_bool,
         CASE WHEN kind = 'int' THEN try_cast(value AS BIGINT) END AS value_long,
         CASE WHEN kind = 'float' THEN try_cast(value AS DOUBLE) END AS value_double,
         CASE WHEN kind = 'list' THEN 'q_proj|' || event_id END AS value_list,
         CASE WHEN kind = 'str' THEN value END AS value_str
  FROM (SELECT event_id, value, {KIND} AS kind FROM (
    SELECT event_id, CASE event_id % 12
      WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' WHEN 2 THEN event_id::VARCHAR
      WHEN 3 THEN '-' || event_id WHEN 4 THEN event_id || '.' WHEN 5 THEN '.' || event_id
      WHEN 6 THEN '-' || event_id || '.25' WHEN 7 THEN event_id || 'e-4'
      WHEN 8 THEN '[''q_proj'', ''' || event_id || ''']' WHEN 9 THEN '[q_proj, ' || event_id
      WHEN 10 THEN '[oops ' || event_id || ']' ELSE event_type END AS value FROM events))""",
    "split_reply": folded(
        """
  SELECT chat_key, block_start, turn_no, content AS message,
         row_number() OVER (PARTITION BY chat_key, block_start, turn_no ORDER BY ts, pos) - 1
         AS part
  FROM (SELECT r.chat_key, r.block_start, v.turn_no, r.content, r.ts, r.pos
        FROM role_runs r
        JOIN bounds b USING (chat_key, block_start)
        JOIN valid v ON v.chat_key = r.chat_key AND v.block_start = r.block_start
                    AND v.turn_no = r.run_no - b.first_user
        WHERE r.role = 'assistant')""",
        PLAIN,
    ),
    "rolling_history": """
  SELECT conv_id, turn, count(*) OVER w AS history_messages,
         (sum(length(text)) OVER w)::BIGINT AS history_chars
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "recent_history": """
  SELECT conv_id, turn, n_earlier, n_history, prompt FROM (
    SELECT conv_id, turn, role, greatest(row_number() OVER o - 3, 0)::BIGINT AS n_earlier,
           count(*) OVER w AS n_history,
           string_agg(coalesce(role, '') || ':' || coalesce(text, ''), chr(10)) OVER w AS prompt
    FROM conversations
    WINDOW o AS (PARTITION BY conv_id ORDER BY turn),
           w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
  WHERE role = 'user'""",
    "validate_requests": """
  SELECT event_id, temperature, reason = 'ok' AS is_valid, reason
  FROM (SELECT event_id, temperature,
               CASE WHEN event_id % 5 IN (1, 2) AND (event_id % 5 = 2
                         OR upper(md5(event_id::VARCHAR)) <> md5(event_id::VARCHAR)) THEN 'run_id'
                    WHEN temperature < 0 OR temperature > 5 THEN 'temperature'
                    WHEN event_id % 7 = 3 THEN 'messages' ELSE 'ok' END AS reason
        FROM (SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN value / 50 - 0.1 ELSE 1.0 END
                     AS temperature FROM events))""",
    # Ledger
    "ledger_filter": from_ledger(f"""
  SELECT {LEDGER_COLUMNS} FROM ledger
  WHERE status IN ('queued', 'failed') AND type = 'data-prep'
    AND regexp_matches(run_id, '(?i)A[0-4]')"""),
    "ledger_sorted": from_ledger(
        f"SELECT {LEDGER_COLUMNS} FROM ledger ORDER BY ledger.created_at DESC, run_id"
    ),
    "queue_position": from_ledger("""
  SELECT run_id, type, row_number() OVER (PARTITION BY type ORDER BY created_at, run_id) AS position
  FROM ledger WHERE status = 'queued'"""),
    "my_runs": from_ledger(f"""
  SELECT {LEDGER_COLUMNS} FROM ledger
  WHERE run_id IN (SELECT md5(event_id::VARCHAR) FROM events WHERE user_id % 10 = 3)"""),
    "queue_with_created": from_ledger("""
  SELECT run_id, row_number() OVER (PARTITION BY type ORDER BY created_at, run_id) AS position,
         CASE WHEN created_at < TIMESTAMP '2024-01-20'
              THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') ELSE '' END AS created
  FROM ledger WHERE status = 'queued'"""),
    "new_submissions": f"""
  SELECT md5(user_id::VARCHAR) AS run_id, event_id, submitted
  FROM (SELECT user_id, event_id, {secs('ts')} AS submitted,
               row_number() OVER (PARTITION BY user_id ORDER BY {secs('ts')}, event_id) AS rn
        FROM events)
  WHERE rn = 1 AND user_id NOT IN
    (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)""",
    "ledger_union": from_ledger("""
  SELECT run_id, type, CASE WHEN status = 'running' THEN 'unknown' ELSE status END AS status,
         coalesce(error, '') AS error FROM ledger"""),
    "queue_summary": from_ledger("""
  SELECT type, bool_or(status = 'running') AS running,
         count(*) FILTER (status = 'queued') AS queue_size,
         count(*) FILTER (status = 'running') AS n_running,
         count(*) FILTER (status = 'completed') AS n_completed,
         count(*) FILTER (status = 'failed') AS n_failed
  FROM ledger GROUP BY type"""),
    "latest_status": """
  SELECT md5(user_id::VARCHAR) AS run_id,
         CASE arg_max(event_type, (ts, event_id)) WHEN 'signup' THEN 'queued'
           WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
         count(*) AS n_events
  FROM events GROUP BY user_id""",
    # Files
    "read_exports": from_raw(f"SELECT name, type, sender, {DATE} AS date, body FROM chat_raw"),
    "read_export_dir": with_ctes("SELECT * FROM chat_sizes", RAW, CHAT_SIZES),
    "export_file_report": with_ctes("SELECT doc, status, n_chats FROM verdicts", DOCS),
    "write_raw": with_ctes("SELECT * FROM chat_sizes", RAW, CHAT_SIZES),
    "read_train_jsonl": folded("SELECT turn_no, role, content FROM valid", PLAIN),
    "run_metadata": folded(
        f"""SELECT key, value, {KIND} AS kind,
         CASE WHEN {KIND} = 'int' THEN try_cast(value AS BIGINT) END AS value_long,
         CASE WHEN {KIND} = 'float' THEN try_cast(value AS DOUBLE) END AS value_double
  FROM entries""",
        (*PLAIN, STATS, ENTRIES),
    ),
    "write_run_layout": folded(
        f"""
  SELECT '{RUN_ID}' AS run_id, dataset, n_lines FROM (
    SELECT 'raw.json' AS dataset, (SELECT sum(n_chats) FROM docs)::BIGINT AS n_lines
    UNION ALL SELECT 'processed.json', sum(greatest(1, n_valid))::BIGINT
      FROM (SELECT count(*) FILTER (outcome = 'valid') AS n_valid FROM reviewed GROUP BY chat_key)
    UNION ALL SELECT 'train.jsonl', count(*) FROM reviewed WHERE outcome = 'valid'
    UNION ALL SELECT 'breakdown.jsonl', count(DISTINCT name) FROM reviewed
    UNION ALL SELECT 'metadata.jsonl', {len(METADATA) + len(STAT_NAMES)})""",
        (*PLAIN, DOCS),
    ),
    "list_runs": folded(
        """SELECT DISTINCT md5((chat_key // 10)::VARCHAR) AS run_id FROM valid ORDER BY run_id""",
        PLAIN,
    ),
    "incremental_prep": folded(
        f"""
  SELECT doc, CASE WHEN status = 'ok' THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN status = 'ok' THEN '' ELSE status END AS error, n_chats,
         CASE WHEN status = 'ok' THEN coalesce(n_valid, 0) ELSE 0 END AS num_blocks,
         CASE WHEN status = 'ok' THEN coalesce(n_valid, 0) ELSE 0 END AS n_train,
         CASE WHEN status = 'ok' THEN {len(METADATA) + len(STAT_NAMES)} ELSE 0 END::BIGINT
           AS n_metadata
  FROM verdicts LEFT JOIN (
    SELECT chat_key // 5 AS doc, count(*) FILTER (outcome = 'valid') AS n_valid
    FROM reviewed GROUP BY ALL) USING (doc)""",
        (*PLAIN, DOCS),
    ),
}
# Byte ranges give what whole documents give.
SQL |= {"split_exports": SQL["read_exports"], "split_file_report": SQL["export_file_report"]}
