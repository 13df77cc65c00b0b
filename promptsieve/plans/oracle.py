"""The registered queries as SQL for an independent engine (DuckDB dialect).

Patterns and phrases are shared with the Spark side; everything else is written a
second time, in SQL, over the same tables.
"""

from __future__ import annotations

from .. import schemas as S
from ..functions import patterns as P
from ..operators import validate as V
from ..operators.verdict import ADVICE, ALLOWED, REASON, UNEXPLAINED
from . import workloads as WL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


# --- prompts ------------------------------------------------------------------

_PHRASES = qlist(WL.PHRASES)


def phrase(key: str) -> str:
    return f"{_PHRASES}[(({key}) % {WL.PHRASE_KEYS}) + 1]"


def asked(key: str) -> str:
    return (
        f"CASE ({key}) % 4 WHEN 0 THEN 'strict' WHEN 1 THEN 'default' "
        "WHEN 2 THEN 'permissive' END"
    )


def _prompts(request_id, key, text, context, app, source) -> str:
    return (
        f"SELECT {request_id} AS request_id, concat_ws(' ', {text}, {phrase(key)}) AS prompt, "
        f"{asked(key)} AS policy_id, {context} AS context, {app} AS app_id FROM {source}"
    )


CORPUS = " UNION ALL ".join(
    (
        _prompts("'doc-' || doc_id", "doc_id", "text", "'rag_result'", "source", "documents"),
        _prompts(
            "'chat-' || conv_id || '-' || turn", "conv_id * 31 + turn", "text",
            "CASE role WHEN 'user' THEN 'user_input' ELSE 'system_message' END",
            "NULL::VARCHAR", "conversations WHERE role IN ('user', 'system')",
        ),
        _prompts("'page-' || page_id", "page_id", "html", "'rag_result'", "'web'", "pages"),
    )
)

_IP = """coalesce(
    CASE WHEN user_id % 3 = 0 THEN '10.0.0.' || (user_id % 20) END,
    CASE WHEN user_id % 13 <> 0 THEN '10.0.1.' || (user_id % 20) END,
    'unknown')"""

TRAFFIC = f"""
SELECT event_id, user_id, event_type, value, props, 'ev-' || event_id AS request_id, ts,
    concat_ws(' ', props, {phrase("event_id")}) AS prompt,
    CASE WHEN event_id % 5 = 4 AND user_id % 10 = 0 THEN 'ghost' ELSE {asked("event_id")} END
        AS policy_id,
    'user_input' AS context, 'app-' || (user_id % 7) AS app_id,
    CASE WHEN user_id % 9 = 0 THEN {_IP}
         WHEN user_id % 9 = 1 THEN left('user-' || user_id || repeat('x', 140), 128)
         ELSE 'user-' || user_id END AS client_id,
    {_IP} AS ip
FROM events"""

FAULTY = f"""
SELECT event_id, request_id, ts, client_id, ip,
    CASE WHEN event_id % 17 = 0 THEN ''
         WHEN event_id % 19 = 0 THEN NULL
         WHEN event_id % 23 = 0 THEN 'bell ' || chr(1) || ' ' || prompt
         WHEN event_id % 97 = 0 THEN repeat('a', 25001)
         WHEN event_id % 89 = 0 THEN repeat(chr(128512), 12501)
         WHEN event_id % 83 = 0 THEN repeat(chr(128512), 12500)
         ELSE prompt END AS prompt,
    CASE WHEN event_id % 29 = 0 THEN 'email' ELSE context END AS context,
    CASE WHEN event_id % 31 = 0 THEN '' ELSE policy_id END AS policy_id,
    CASE WHEN event_id % 37 = 0 THEN '' ELSE app_id END AS app_id
FROM ({TRAFFIC})"""


def units(text: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({text}) + length(regexp_extract_all({text}, {q(P.ASTRAL)})))"


# --- sanitizer and detectors ----------------------------------------------------

# The only compatibility characters in these texts are the planted full-width letters.
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def sanitized(prompts: str) -> str:
    count = lambda c: f"length(regexp_extract_all(prompt, {q(c)}))"
    return f"""
SELECT * EXCLUDE (folded),
    translate(folded, {q(P.HOMOGLYPH_FROM)}, {q(P.HOMOGLYPH_TO)}) AS normalized,
    list_filter([CASE WHEN tags > 0 THEN 'tag_chars' END, CASE WHEN bidi > 0 THEN 'bidi_control' END,
        CASE WHEN zero > 0 THEN 'zero_width' END,
        CASE WHEN regexp_matches(folded, {q(P.HOMOGLYPH_CLASS)}) THEN 'homoglyph' END],
        lambda x: x IS NOT NULL) AS obf,
    tags + bidi + zero AS removed
FROM (SELECT *, {count(P.TAG_CHARS)} AS tags, {count(P.BIDI_CONTROL)} AS bidi,
        {count(P.ZERO_WIDTH)} AS zero,
        translate(regexp_replace(prompt, {q(P.HIDDEN_CHARS)}, '', 'g'), {q(_FULL)}, {q(_HALF)})
            AS folded
      FROM ({prompts}))"""


def _hit_list(patterns) -> str:
    parts = []
    for p in patterns:
        found = f"regexp_extract_all(normalized, {q(p.re2)})"
        parts.append(
            f"list_transform(list_filter({found}, lambda x, i: list_position({found}, x) = i), "
            f"lambda m: {{'type': {q(p.name)}, 'match': m}})"
        )
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


def found(prompts: str) -> str:
    """Evidence per prompt."""
    wide = f"regexp_replace(normalized, {q(P.ASTRAL)}, '##', 'g')"
    flags = ", ".join(
        f"regexp_matches({wide if p.name == 'system_prompt_extraction' else 'normalized'}, "
        f"{q(p.re2)}) AS f{i}"
        for i, p in enumerate(P.INJECTION)
    )
    total = " + ".join(
        f"CASE WHEN f{i} THEN {p.weight}::DOUBLE ELSE 0::DOUBLE END"
        for i, p in enumerate(P.INJECTION)
    )
    return f"""
SELECT * EXCLUDE (f0, f1, f2, f3, f4, medical, legal),
    least({S.INJECTION_CONFIDENCE_CAP}::DOUBLE, {total}) AS conf,
    list_filter([CASE WHEN f0 OR f1 THEN 'instruction_override' END,
        CASE WHEN f2 THEN 'system_prompt_extraction' END,
        CASE WHEN f3 THEN 'role_play_bypass' END, CASE WHEN f4 THEN 'jailbreak' END],
        lambda x: x IS NOT NULL) AS signs,
    list_filter([CASE WHEN medical THEN 'medical_diagnosis' END,
        CASE WHEN legal THEN 'legal_advice' END], lambda x: x IS NOT NULL) AS topics_hit
FROM (SELECT *, {_hit_list(P.PII)} AS pii, {_hit_list(P.SECRETS)} AS secrets, {flags},
        regexp_matches(normalized, {q(P.TOPICS[0].re2)}) AS medical,
        regexp_matches(normalized, {q(P.TOPICS[1].re2)}) AS legal,
        regexp_matches(normalized, {q(P.MISCONDUCT.re2)}) AS misconduct
      FROM ({sanitized(prompts)}))"""


# --- policies and verdicts --------------------------------------------------------

_BUNDLED = """
    ('strict', 'block', 0.5::DOUBLE, 'anonymize', ['medical_diagnosis', 'legal_advice'], 'HIGH'),
    ('default', 'block', 0.7::DOUBLE, 'anonymize', []::VARCHAR[], 'MEDIUM'),
    ('permissive', 'flag', 0.9::DOUBLE, 'anonymize', []::VARCHAR[], 'LOW')"""
_EXTRA = """,
    ('quiet', 'off', 0.5::DOUBLE, 'placeholder', ['legal_advice', 'astrology'], 'MEDIUM'),
    ('sealed', 'block', 0.9::DOUBLE, 'block-on-detect', []::VARCHAR[], 'MEDIUM')"""


def policies(extra: bool = False) -> str:
    return (
        f"(SELECT * FROM (VALUES {_BUNDLED}{_EXTRA if extra else ''}) "
        "AS p(pid, mode, threshold, style, denied, strength))"
    )


def _score(level: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in S.CONFIDENCE_TO_SCORE.items())
    return f"CASE {level} {cases} END"


def _span(match: str) -> str:
    start = units(f"substr(normalized, 1, strpos(normalized, {match}) - 1)")
    return start, f"({start} + {units(match)})"


def _match(category, type_, confidence, detail, span=("NULL::BIGINT", "NULL::BIGINT")) -> str:
    return (
        f"{{'category': {category}, 'type': {type_}, 'confidence': ({confidence})::DOUBLE, "
        f"'detail': {detail}, 's': ({span[0]})::BIGINT, 'e': ({span[1]})::BIGINT}}"
    )


def _entity(category: str, label: str, action: str, hits: str) -> str:
    return f"list_transform({hits}, lambda h: " + _match(
        q(category), "h.type", "1", q(f"{label} detected ({action})"), _span("h.match")
    ) + ")"


def _if(condition: str, match: str) -> str:
    return f"(CASE WHEN {condition} THEN [{match}] ELSE [] END)"


def _concat(parts) -> str:
    out = parts[0]
    for part in parts[1:]:
        out = f"list_concat({out}, {part})"
    return out


def mask(text: str, hits: str, opening: str, closing: str) -> str:
    pairs = f"list_transform({hits}, lambda h: h.match || chr(2) || h.type)"
    return (
        f"list_reduce(list_prepend({text}, {pairs}), lambda acc, x: replace(acc, "
        f"split_part(x, chr(2), 1), {opening} || split_part(x, chr(2), 2) || {closing}))"
    )


def judged(prompts: str, every_policy: bool = False, extra: bool = False) -> str:
    """Verdicts: under the policy asked for, or under every policy."""
    join = (
        f"FROM ({found(prompts)}) e, {policies(extra)} p"
        if every_policy
        else f"FROM ({found(prompts)}) e JOIN {policies(extra)} p "
        "ON coalesce(e.policy_id, 'default') = p.pid"
    )
    matches = _concat(
        [
            _entity("secrets", "Secret", "BLOCKED", "secrets"),
            _entity("pii", "PII", "ANONYMIZED", "pii"),
            _if(
                "conf > 0",
                _match(
                    "'prompt_injection'", "'PROMPT_ATTACK'", _score("attack"),
                    "'Guardrail PROMPT_ATTACK content filter'",
                ),
            ),
            _if(
                "fired",
                _match(
                    "'prompt_injection'", "'injection_screener'", "conf",
                    "array_to_string(signs, ', ')",
                ),
            ),
            "list_transform(topics, lambda t: "
            + _match(
                "'topic'", "t", f"CASE WHEN mode <> 'off' THEN {S.TOPIC_HIT_SCORE} ELSE 1 END",
                "'Denied topic (BLOCKED)'",
            )
            + ")",
            _if(
                "misconduct",
                _match(
                    "'content'", "'MISCONDUCT'", _score("level"),
                    "'Content filter (' || level || ')'",
                ),
            ),
            _if(
                "len(obf) > 0",
                _match(
                    "'obfuscation'", "'unicode_obfuscation'", "0.5", "array_to_string(obf, ', ')"
                ),
            ),
        ]
    )
    return f"""
SELECT *,
    CASE decision WHEN 'block' THEN 'block' WHEN 'redact' THEN 'redact_and_proceed'
        ELSE 'allow' END AS recommended_action,
    CASE WHEN decision = 'redact' THEN {mask(
        "normalized", "pii", "CASE style WHEN 'placeholder' THEN '[' ELSE '{' END",
        "CASE style WHEN 'placeholder' THEN ']' ELSE '}' END")} END AS redacted_prompt,
    {matches} AS matches,
    greatest(CASE WHEN mode <> 'off' THEN conf ELSE 0 END,
        CASE WHEN conf > 0 THEN {_score("attack")} ELSE 0 END)::DOUBLE AS injection_score
FROM (SELECT *,
    CASE WHEN len(secrets) > 0 OR (len(pii) > 0 AND style = 'block-on-detect')
            OR (conf > 0 AND strength <> 'LOW') OR (fired AND mode = 'block')
            OR len(topics) > 0 OR (misconduct AND strength <> 'LOW') THEN 'block'
         WHEN len(pii) > 0 THEN 'redact' ELSE 'allow' END AS decision
  FROM (SELECT e.* EXCLUDE (policy_id), p.*, p.pid AS policy_id,
      list_filter(denied, lambda t: list_contains(topics_hit, t)) AS topics,
      mode <> 'off' AND conf > 0 AND conf >= threshold AS fired,
      CASE WHEN conf >= 0.7 THEN 'HIGH' WHEN conf >= 0.4 THEN 'MEDIUM' WHEN conf > 0 THEN 'LOW'
          ELSE 'NONE' END AS attack,
      CASE WHEN strength = 'LOW' THEN 'LOW' ELSE 'HIGH' END AS level,
      CASE WHEN mode <> 'off' THEN {_escalates()} END AS escalated
    {join}))"""


def _escalates() -> str:
    return f"(len(obf) > 0 OR (conf > 0 AND conf < {S.STRONG_SIGNAL}))"


def _reason_of() -> str:
    return f"""CASE WHEN len(obf) > 0 THEN 'obfuscation present'
        WHEN conf = 0 THEN 'no deterministic signal'
        WHEN conf >= {S.STRONG_SIGNAL} THEN 'high-confidence deterministic hit'
        ELSE 'borderline deterministic signal' END"""


def _explain(part: str) -> str:
    """Reason or advice from `matches` and `decision`."""
    texts = REASON if part == "reason" else ADVICE
    allowed, other = (ALLOWED[0], UNEXPLAINED[0]) if part == "reason" else (ALLOWED[1], UNEXPLAINED[1])
    cases = ""
    for category in S.MATCH_PRECEDENCE:
        first = f"list_filter(matches, lambda m: m.category = {q(category)})[1].type"
        before, hole, after = texts[category].partition("{t}")
        text = f"{q(before)} || {first} || {q(after)}" if hole else q(before)
        cases += f" WHEN {first} IS NOT NULL THEN {text}"
    return f"CASE WHEN decision = 'allow' THEN {q(allowed)}{cases} ELSE {q(other)} END"


def _exploded_matches(verdicts: str, columns: str) -> str:
    return (
        f"SELECT {columns}, pos - 1 AS pos, m.category, m.type, m.confidence, m.detail, m.s, m.e "
        f"FROM (SELECT {columns}, unnest(matches) AS m, generate_subscripts(matches, 1) AS pos "
        f"FROM ({verdicts}))"
    )


# --- audit ---------------------------------------------------------------------------


def audit() -> str:
    """The audit table after all writes, last write of a request winning."""
    verdicts = judged(TRAFFIC)
    replays = judged(
        f"SELECT t.* FROM ({TRAFFIC}) t WHERE event_type = 'error' "
        "AND coalesce(policy_id, 'default') <> 'ghost'",
        every_policy=True,
    )
    columns = "request_id, policy_id, context, prompt, decision, recommended_action, matches, "
    columns += "injection_score, ts, app_id, value, user_id, replay_of"
    return f"""
SELECT {columns} FROM (
    SELECT * EXCLUDE (app_id, ts), CASE WHEN user_id % 50 = 0 THEN 'retry' ELSE app_id END AS app_id,
        CASE WHEN user_id % 50 = 0 AND event_id % 2 = 0 THEN ts + INTERVAL 1 DAY
            ELSE ts END AS ts,
        NULL::VARCHAR AS replay_of FROM ({verdicts}))
UNION ALL
SELECT {columns} FROM (
    SELECT * EXCLUDE (request_id, ts), request_id AS replay_of, TIMESTAMP '2030-01-01' AS ts,
        md5('replay:errors:' || request_id || ':' || policy_id) AS request_id FROM ({replays}))"""


_LATENCY = """
SELECT unnest(['policy', 'guardrail', 'injection', 'total']) AS leg,
    unnest([floor(value)::BIGINT % 2 + 0.25::DOUBLE, 30::DOUBLE, floor(value)::BIGINT % 300 + 0.4::DOUBLE,
        30 + (floor(value)::BIGINT % 300 + 0.4::DOUBLE) + (floor(value)::BIGINT % 2 + 0.25::DOUBLE)]) AS ms
FROM a WHERE replay_of IS NULL"""

# --- rate limits -----------------------------------------------------------------------

_L = WL.LIMITS


def tiers(requests: str) -> str:
    rows = (
        (0, "user/hour", "'u:' || client_id || ':h'", 3600, _L.user_per_hour),
        (1, "user/day", "'u:' || client_id || ':d'", 86400, _L.user_per_day),
        (2, "ip/hour", "'ip:' || ip || ':h'", 3600, _L.ip_per_hour),
        (3, "ip/day", "'ip:' || ip || ':d'", 86400, _L.ip_per_day),
        (4, "global/day", "'g:all:d'", 86400, _L.global_per_day),
    )
    parts = [
        f"SELECT request_id, ts, {t} AS tier, {q(scope)} AS scope, {key} AS counter, "
        f"{w} AS win, {limit} AS lim, epoch_us(ts) // 1000000 AS sec, "
        f"(epoch_us(ts) // 1000000) // {w} AS bucket FROM ({requests})"
        for t, scope, key, w, limit in rows
    ]
    return " UNION ALL ".join(parts)


def denials(requests: str) -> str:
    return f"""
SELECT request_id, arg_min(scope, tier) AS scope,
    arg_min(greatest(1, (bucket + 1) * win - sec), tier) AS retry_after_seconds,
    count(*) AS breached_tiers
FROM (SELECT *, row_number() OVER (PARTITION BY counter, bucket ORDER BY ts, request_id) AS n
      FROM ({tiers(requests)}))
WHERE n > lim GROUP BY request_id"""


_ARRIVALS = f"""
WITH span AS (
    SELECT min(epoch_us(ts) // 1000000) AS lo, max(epoch_us(ts) // 1000000) AS hi FROM ({TRAFFIC})
), cut AS (
    SELECT t.*, (epoch_us(ts) // 1000000 - lo) * {WL.ARRIVALS - 1} AS past, hi - lo + 1 AS span
    FROM ({TRAFFIC}) t, span
), slotted AS (
    SELECT *, past // span + (event_id % {WL.LATE_KEYS[0]} = {WL.LATE_KEYS[1]}
        OR event_id % 3 = 0 AND (past // span + 1) * span - past < {WL.LATE_SECONDS * (WL.ARRIVALS - 1)})::INT AS slot
    FROM cut
), newest AS (
    SELECT slot, max(max(epoch_us(ts) // 1000000)) OVER (
        ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS horizon
    FROM slotted GROUP BY slot
)
SELECT s.*, n.horizon FROM slotted s JOIN newest n USING (slot)"""


def delivered(requests: str) -> str:
    """Limits over deliveries (slot) in order; windows over at `horizon` do not count."""
    return f"""
WITH r AS MATERIALIZED ({requests}), t AS (
    SELECT t.*, r.slot, coalesce((t.bucket + 1) * t.win <= r.horizon, false) AS late
    FROM ({tiers("r")}) t JOIN r ON r.request_id = t.request_id
), d AS (
    SELECT request_id, arg_min(scope, tier) AS scope,
        arg_min(greatest(1, (bucket + 1) * win - sec), tier) AS retry_after_seconds
    FROM (SELECT *, row_number() OVER (PARTITION BY counter, bucket ORDER BY slot, ts, request_id) AS n
          FROM t WHERE NOT late)
    WHERE n > lim GROUP BY request_id
), l AS (SELECT request_id, bool_or(late) AS late FROM t GROUP BY request_id)
SELECT l.request_id, d.scope IS NULL AS allowed, d.scope, d.retry_after_seconds, l.late
FROM l LEFT JOIN d ON d.request_id = l.request_id"""


# --- ingested answers --------------------------------------------------------------------

_EVENT_ACTION = """CASE event_type WHEN 'error' THEN 'BLOCKED' WHEN 'click' THEN 'ANONYMIZED'
    ELSE 'NONE' END"""
_ENTITY_TYPE = """CASE user_id % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'NAME' WHEN 2 THEN 'AWS_ACCESS_KEY'
    WHEN 3 THEN 'PASSWORD' WHEN 4 THEN 'UNKNOWN' ELSE 'PHONE' END"""

# One row per event with a readable assessment; each flattened list as columns.
ASSESSED = f"""
SELECT *, value > 10 AS intervened,
    CASE WHEN entity_type IN ('AWS_ACCESS_KEY', 'PASSWORD')
        THEN [{{'type': entity_type, 'action': act, 'detected': entity_detected, 'match': entity_match}}]
        ELSE [] END AS managed_secrets,
    CASE WHEN entity_type NOT IN ('AWS_ACCESS_KEY', 'PASSWORD')
        THEN [{{'type': entity_type, 'action': act, 'detected': entity_detected, 'match': entity_match}}]
        ELSE [] END AS g_pii,
    CASE WHEN value > 20 THEN [{{'type': CASE WHEN event_id % 4 = 0 THEN 'REGEX' ELSE 'custom_key' END,
        'action': 'BLOCKED', 'detected': true, 'match': props}}] ELSE [] END AS custom_secrets,
    CASE WHEN event_id % 5 <> 0 THEN [{{'type': 'medical_diagnosis', 'action': act,
        'detected': act <> 'NONE'}}] ELSE [] END AS g_topics,
    CASE WHEN event_id % 4 = 0 OR event_id % 4 = 3 THEN [{{
        'type': CASE WHEN event_id % 4 = 0 THEN 'HATE' ELSE 'PROMPT_ATTACK' END,
        'action': act, 'detected': act <> 'NONE',
        'confidence': CASE user_id % 4 WHEN 0 THEN 'NONE' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM'
            ELSE 'HIGH' END}}] ELSE [] END AS g_content
FROM (SELECT *, {_EVENT_ACTION} AS act, {_ENTITY_TYPE} AS entity_type,
        CASE event_id % 3 WHEN 1 THEN true WHEN 2 THEN false
            ELSE ({_EVENT_ACTION}) <> 'NONE' END AS entity_detected,
        '"k": ' || regexp_extract(props, '(\\d+)', 1) AS entity_match
      FROM events WHERE event_id % 53 <> 0 AND event_id % 50 <> 7)"""

_RESPONSES = """
SELECT 'ev-' || event_id AS request_id, 'primary' AS model, event_id % 3 = 1 AS ok,
    CASE WHEN event_id % 3 = 1 THEN value > 30 END AS detected,
    CASE WHEN event_id % 3 = 1 THEN (user_id % 101) / 100.0::DOUBLE END AS confidence,
    CASE WHEN event_id % 3 = 1 THEN 'model' END AS indicators,
    CASE WHEN event_id % 3 = 1 THEN 0.5::DOUBLE END AS medical_score, event_id, user_id FROM events
UNION ALL
SELECT 'ev-' || event_id, 'fallback', event_id % 2 = 0, CASE WHEN event_id % 2 = 0 THEN false END,
    CASE WHEN event_id % 2 = 0 THEN 0.25::DOUBLE END, CASE WHEN event_id % 2 = 0 THEN '' END,
    NULL::DOUBLE, event_id, user_id FROM events"""

_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


def _issue(path: str, message: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN {{'path': {q(path)}, 'message': {message}}} END"


_ISSUES = (
    "list_filter(["
    + ", ".join(
        (
            _issue("prompt", q(V.REQUIRED), "prompt IS NULL"),
            _issue("prompt", q(V.TOO_SHORT), "prompt = ''"),
            _issue("prompt", q(V.TOO_LONG), f"{units('prompt')} > {S.MAX_PROMPT_LENGTH}"),
            _issue("prompt", q(V.CONTROL), f"regexp_matches(prompt, {q(P.CONTROL_CHARS)})"),
            _issue("policyId", q(V.TOO_SHORT), "policy_id = ''"),
            _issue(
                "context",
                q(
                    "Invalid enum value. Expected "
                    + " | ".join(f"'{c}'" for c in S.PROMPT_CONTEXTS)
                    + ", received '"
                )
                + " || context || ''''",
                "context NOT IN ('user_input', 'system_message', 'rag_result')",
            ),
            _issue("appId", q(V.TOO_SHORT), "app_id = ''"),
        )
    )
    + "], lambda x: x IS NOT NULL)"
)

_OUTCOMES = f"""
SELECT request_id, status,
    CASE status WHEN 200 THEN 'OK' WHEN 400 THEN 'Validation failed' WHEN 404 THEN 'Not Found'
        WHEN 429 THEN 'Too Many Requests' WHEN 503 THEN 'Service Unavailable' END AS title,
    CASE status
        WHEN 429 THEN 'Rate limit exceeded (' || scope || '). Retry after ' || retry || 's.'
        WHEN 404 THEN 'Unknown policy: ''' || policy_id || ''''
        WHEN 503 THEN {q(V.GUARDRAIL_DOWN)} END AS detail,
    retry AS retry_after_seconds
FROM (SELECT f.request_id, coalesce(f.policy_id, 'default') AS policy_id, d.scope,
        d.retry_after_seconds AS retry,
        CASE WHEN d.request_id IS NOT NULL THEN 429
             WHEN len({_ISSUES}) > 0 THEN 400
             WHEN coalesce(f.policy_id, 'default') NOT IN ('strict', 'default', 'permissive') THEN 404
             WHEN event_id % 53 = 0 OR event_id % 50 = 7 THEN 503 ELSE 200 END::BIGINT AS status
      FROM ({FAULTY}) f LEFT JOIN ({denials(TRAFFIC)}) d ON f.request_id = d.request_id)"""

#: The same without stored assessments: the engine's own detectors answer always.
_VERIFIED = _OUTCOMES.replace("WHEN event_id % 53 = 0 OR event_id % 50 = 7 THEN 503 ", "")

_REPLAY_REQUESTS = """
SELECT CASE WHEN event_id % 6 = 0 THEN 'lost-' || event_id ELSE 'ev-' || event_id END AS request_id
FROM events WHERE event_type = 'purchase'"""

_SCORE_ROWS = f"""
SELECT policy_id, 'signal' AS panel, 'pii' AS name, (len(pii) > 0)::INT::DOUBLE AS score FROM v
UNION ALL SELECT policy_id, 'signal', 'secrets', (len(secrets) > 0)::INT::DOUBLE FROM v
UNION ALL SELECT policy_id, 'signal', 'prompt_injection', injection_score FROM v
UNION ALL SELECT policy_id, 'topics', t,
    CASE WHEN list_contains(topics_hit, t) THEN {S.TOPIC_HIT_SCORE} ELSE {S.TOPIC_MISS_SCORE} END::DOUBLE
    FROM (SELECT policy_id, topics_hit, unnest(denied) AS t FROM v)
UNION ALL SELECT policy_id, 'content', c,
    CASE WHEN c = 'MISCONDUCT' AND misconduct THEN {_score("level")} ELSE 0 END::DOUBLE
    FROM (SELECT policy_id, misconduct, level, unnest({qlist(S.CONTENT_FILTERS)}) AS c FROM v)"""


def _with(name: str, sql: str, select: str) -> str:
    return f"WITH {name} AS MATERIALIZED ({sql}) {select}"


def _percent(x: str) -> str:
    return f"floor({x} * 100 + 0.5)::BIGINT || '%'"


def oracles() -> dict[str, str]:
    ev = found(CORPUS)
    own = judged(CORPUS)
    matrix = judged(CORPUS, every_policy=True)
    wide = judged(CORPUS, every_policy=True, extra=True)
    pairs = _with(
        "a", audit(),
        """, p AS (SELECT o.request_id, r.request_id AS replay_id, o.policy_id AS from_policy,
            r.policy_id AS to_policy, o.decision AS from_decision, r.decision AS to_decision,
            o.matches AS om, r.matches AS rm, o.injection_score AS oi, r.injection_score AS ri
        FROM a r JOIN a o ON r.replay_of = o.request_id) """,
    )
    names = lambda m: f"list_transform({m}, lambda x: x.category || ':' || x.type)"
    first_only = lambda a, b: (  # noqa: E731  (distinct, in order of first appearance)
        f"array_to_string(list_filter({names(a)}, lambda x, i: list_position({names(a)}, x) = i "
        f"AND NOT list_contains({names(b)}, x)), ',')"
    )
    percentile = lambda p: f"quantile_cont(ms, {p})::DOUBLE"
    return {
        "src_prompts_by_context": f"""SELECT context, count(*) AS n, sum(length(prompt))::BIGINT AS chars
            FROM ({CORPUS}) GROUP BY context""",
        "policy_list": f"""SELECT pid AS id, mode, threshold, style AS redaction_style, strength,
            'guard-' || pid AS guardrail_id, '1' AS guardrail_version,
            array_to_string(denied, ',') AS denied_topics, requests
            FROM {policies()} LEFT JOIN (SELECT coalesce(policy_id, 'default') AS wanted,
                count(*) AS requests FROM ({TRAFFIC}) GROUP BY 1) ON wanted = pid""",
        "policy_files": f"""SELECT 'tenant_' || s_suppkey AS id,
            {qlist(S.INJECTION_MODES)}[s_suppkey % {len(S.INJECTION_MODES)} + 1] AS mode,
            (s_suppkey % 101)::DOUBLE / 100 AS threshold,
            {qlist(S.REDACTION_STYLES)}[s_suppkey % {len(S.REDACTION_STYLES)} + 1] AS redaction_style,
            {q(S.DEFAULT_STRENGTH)} AS strength, 'g-' || s_nationkey AS guardrail_id, '2' AS guardrail_version,
            CASE WHEN s_suppkey % 4 <> 0 THEN 'legal_advice,topic_' || s_suppkey ELSE '' END AS denied_topics,
            (SELECT count(*) FROM events WHERE user_id = s_suppkey) AS requests FROM supplier""",
        "policy_binding_overlay": """SELECT 'tenant_' || c_custkey AS id,
            CASE WHEN c_acctbal > 0 AND c_custkey % 11 <> 0 THEN 'g-' || c_mktsegment
                ELSE 'guard-placeholder' END AS guardrail_id,
            CASE WHEN c_acctbal > 0 AND c_custkey % 11 <> 0 THEN c_nationkey::VARCHAR
                ELSE '1' END AS guardrail_version FROM customer""",
        "assessment_flatten": f"""WITH r AS (SELECT 'ev-' || event_id AS request_id, intervened,
                event_type AS redacted_text,
                list_concat(list_concat(list_concat(
                    list_transform(g_pii, lambda x: {{'kind': 'pii', 'type': x.type, 'action': x.action,
                        'detected': x.detected, 'confidence': NULL::VARCHAR, 'match': x.match}}),
                    list_transform(list_concat(managed_secrets, custom_secrets), lambda x: {{'kind': 'secret',
                        'type': x.type, 'action': x.action, 'detected': x.detected,
                        'confidence': NULL::VARCHAR, 'match': x.match}})),
                    list_transform(g_topics, lambda x: {{'kind': 'topic', 'type': x.type, 'action': x.action,
                        'detected': x.detected, 'confidence': NULL::VARCHAR, 'match': NULL::VARCHAR}})),
                    list_transform(g_content, lambda x: {{'kind': 'content', 'type': x.type,
                        'action': x.action, 'detected': x.detected, 'confidence': x.confidence,
                        'match': NULL::VARCHAR}})) AS rows FROM ({ASSESSED}))
            SELECT request_id, intervened, redacted_text, pos - 1 AS pos, e.kind, e.type, e.action,
                e.detected, e.confidence, e.match
            FROM (SELECT request_id, intervened, redacted_text, unnest(rows) AS e,
                generate_subscripts(rows, 1) AS pos FROM r)""",
        "screener_extract": f"""SELECT request_id, model, ok, detected, confidence, indicators,
            medical_score FROM ({_RESPONSES})""",
        "screener_token_usage": f"""SELECT model, count(*) AS calls, count(*) FILTER (WHERE ok) AS answered,
            sum(CASE WHEN event_id % 7 <> 0 THEN event_id % 50 + 100 ELSE 0 END)::BIGINT AS input_tokens,
            sum(CASE WHEN event_id % 7 <> 0 THEN user_id % 20 ELSE 0 END)::BIGINT AS output_tokens
            FROM ({_RESPONSES}) GROUP BY model""",
        "val_length": f"""SELECT request_id, {units('prompt')} AS units,
            {units('prompt')} > {S.MAX_PROMPT_LENGTH} AS too_long FROM ({CORPUS})""",
        "val_reject_reasons": f"""SELECT i.path, i.message, count(*) AS n
            FROM (SELECT unnest({_ISSUES}) AS i FROM ({FAULTY})) GROUP BY 1, 2""",
        "val_defaults": f"""SELECT coalesce(policy_id, 'default') AS policy_id,
            policy_id IS NULL AS absent, count(*) AS n FROM ({CORPUS}) GROUP BY 1, 2""",
        "val_unknown_policy": f"""SELECT request_id, 'Unknown policy: ''' || policy_id || '''' AS detail
            FROM ({TRAFFIC}) WHERE policy_id = 'ghost'""",
        "dq_verdict_violations": f"""WITH k AS (SELECT regexp_extract(request_id, '(\\d+)$', 1)::BIGINT AS k
                FROM ({CORPUS}))
            SELECT v AS violation, count(*) AS n FROM (
                SELECT unnest(CASE WHEN k % 41 <> 0 AND k % 43 <> 0 AND k % 47 <> 0 THEN ['none']
                    ELSE list_filter([CASE WHEN k % 41 = 0 THEN 'decision' END,
                        CASE WHEN k % 47 = 0 THEN 'scores' END, CASE WHEN k % 43 = 0 THEN 'reason' END],
                        lambda x: x IS NOT NULL) END) AS v FROM k) GROUP BY 1""",
        "outcome_by_status": f"""SELECT status, title, count(*) AS n, count(detail) AS with_detail,
            max(retry_after_seconds) AS longest_retry FROM ({_OUTCOMES}) GROUP BY 1, 2""",
        "outcome_details": f"""SELECT request_id, status, detail FROM ({_OUTCOMES})
            WHERE status <> 200""",
        "san_strip": f"""SELECT request_id, removed, length(normalized) AS chars,
            array_to_string(obf, ',') AS indicators FROM ({sanitized(CORPUS)})""",
        "san_nfkc": f"""SELECT request_id, md5(translate(prompt, {q(_FULL)}, {q(_HALF)})) AS digest
            FROM ({CORPUS})""",
        "san_homoglyph": f"""SELECT request_id, list_contains(obf, 'homoglyph') AS folded,
            md5(normalized) AS digest FROM ({sanitized(CORPUS)})""",
        "san_obfuscation_stats": f"""SELECT array_to_string(obf, ',') AS indicators,
            len(obf) > 0 AS obfuscated, count(*) AS n, sum(removed)::BIGINT AS removed
            FROM ({sanitized(CORPUS)}) GROUP BY 1, 2""",
        **{
            name: f"""SELECT request_id, pos - 1 AS pos, h.type, h.match FROM (SELECT request_id,
                unnest({column}) AS h, generate_subscripts({column}, 1) AS pos FROM ({ev}))"""
            for name, column in (("det_pii", "pii"), ("det_secrets", "secrets"))
        },
        "det_misconduct": f"SELECT request_id, misconduct FROM ({ev})",
        "det_injection": f"""SELECT request_id, conf AS confidence,
            array_to_string(signs, ',') AS indicators FROM ({ev})""",
        "det_topics": f"""SELECT request_id, unnest(CASE WHEN len(topics_hit) > 0 THEN topics_hit
            ELSE [NULL::VARCHAR] END) AS topic FROM ({ev})""",
        "det_topic_scores": f"""SELECT request_id, policy_id, topic,
            CASE WHEN list_contains(topics_hit, topic) THEN {S.TOPIC_HIT_SCORE}
                ELSE {S.TOPIC_MISS_SCORE} END::DOUBLE AS score
            FROM (SELECT e.request_id, pid AS policy_id, topics_hit, unnest(denied) AS topic
                FROM ({ev}) e, {policies(True)})""",
        "evidence_counts": _with("v", matrix, """SELECT policy_id, kind, type, action, count(*) AS n FROM (
            SELECT policy_id, 'pii' AS kind, unnest(pii).type AS type, 'ANONYMIZED' AS action FROM v
            UNION ALL SELECT policy_id, 'secret', unnest(secrets).type, 'BLOCKED' FROM v
            UNION ALL SELECT policy_id, 'topic', unnest(topics), 'BLOCKED' FROM v) GROUP BY ALL"""),
        "content_scores": _with("v", matrix, f"""SELECT policy_id, type, confidence, action, detected,
            count(*) AS n, {_score("confidence")} AS score FROM (
            SELECT policy_id, c AS type, c = 'MISCONDUCT' AND misconduct AS detected,
                CASE WHEN c = 'MISCONDUCT' AND misconduct THEN level ELSE 'NONE' END AS confidence,
                CASE WHEN c = 'MISCONDUCT' AND misconduct AND strength <> 'LOW' THEN 'BLOCKED'
                    ELSE 'NONE' END AS action
            FROM (SELECT *, unnest({qlist(S.CONTENT_FILTERS)}) AS c FROM v)
            UNION ALL SELECT policy_id, 'PROMPT_ATTACK', true, attack,
                CASE WHEN strength = 'LOW' THEN 'NONE' ELSE 'BLOCKED' END FROM v WHERE conf > 0)
            GROUP BY ALL"""),
        "prompt_attack_levels": _with("v", matrix, """SELECT policy_id,
            CASE WHEN conf > 0 THEN attack END AS confidence,
            CASE WHEN conf > 0 THEN CASE WHEN strength = 'LOW' THEN 'NONE' ELSE 'BLOCKED' END END AS action,
            count(*) AS n FROM v GROUP BY ALL"""),
        "redact_full": f"""SELECT request_id, md5(t) AS digest, length(t) AS chars FROM (
            SELECT request_id, {mask("normalized", "list_concat(pii, secrets)", "'{'", "'}'")} AS t
            FROM ({ev}))""",
        "intervened_rate": _with("v", matrix, """SELECT policy_id, count(*) AS n,
            count(*) FILTER (WHERE len(secrets) > 0 OR len(pii) > 0 OR len(topics) > 0
                OR (strength <> 'LOW' AND (misconduct OR conf > 0))) AS intervened
            FROM v GROUP BY 1"""),
        "inj_mode_off": _with("v", wide, """SELECT policy_id, mode, escalated, count(*) AS n,
            sum(fired::INT)::BIGINT AS screener_matches,
            count(*) FILTER (WHERE mode <> 'off') AS screened FROM v GROUP BY ALL"""),
        "inj_escalation_reasons": f"""SELECT {_escalates()} AS escalate, {_reason_of()} AS reason,
            count(*) AS n FROM ({ev}) GROUP BY ALL""",
        "inj_escalated_set": f"""SELECT request_id, {_reason_of()} AS reason FROM ({ev})
            WHERE {_escalates()}""",
        "inj_fail_open": f"""WITH m AS (
                SELECT request_id, arg_min(model, CASE model WHEN 'primary' THEN 1 ELSE 2 END) AS model,
                    arg_min(detected, CASE model WHEN 'primary' THEN 1 ELSE 2 END) AS detected,
                    arg_min(confidence, CASE model WHEN 'primary' THEN 1 ELSE 2 END) AS confidence
                FROM ({_RESPONSES}) WHERE ok GROUP BY 1)
            SELECT v.request_id, CASE WHEN v.escalated THEN m.model END AS answered_by,
                v.escalated AND m.model IS NULL AS skipped,
                v.escalated AND m.model IS NOT NULL AS escalated,
                CASE WHEN NOT v.escalated THEN v.conf > 0 ELSE coalesce(m.detected, false) END AS detected,
                CASE WHEN NOT v.escalated THEN v.conf ELSE coalesce(m.confidence, 0) END AS confidence
            FROM ({judged(TRAFFIC)}) v LEFT JOIN m ON v.request_id = m.request_id""",
        "inj_scorer": f"""SELECT request_id, escalated AND bad AS skipped, escalated AND NOT bad AS escalated,
                CASE WHEN NOT escalated THEN conf > 0 ELSE NOT bad AND size % 2 = 0 END AS detected,
                CASE WHEN NOT escalated THEN conf WHEN bad THEN 0 ELSE (size % 101)::DOUBLE / 100 END AS confidence
            FROM (SELECT *, length(normalized) AS size,
                length(normalized) % 7 = 0 OR length(normalized) % 13 = 0 AS bad FROM ({judged(TRAFFIC)}))""",
        "guardrail_fail_closed": _fail_closed(TRAFFIC),
        "verdict_matches": _exploded_matches(own, "request_id, policy_id").replace(", m.s, m.e ", " "),
        "verdict_spans": f"""SELECT request_id, pos, s AS span_start, e AS span_end
            FROM ({_exploded_matches(own, "request_id")}) WHERE s IS NOT NULL""",
        "verdict_scores": f"""SELECT request_id, policy_id, (len(pii) > 0)::INT::DOUBLE AS pii,
            (len(secrets) > 0)::INT::DOUBLE AS secrets, injection_score AS prompt_injection,
            array_to_string(list_sort(list_transform(denied, lambda t: t || '=' ||
                CASE WHEN list_contains(topics_hit, t) THEN '92%' ELSE '4%' END)), ',') AS topics,
            'HATE=0%,INSULTS=0%,MISCONDUCT=' || CASE WHEN misconduct THEN {_percent(_score("level"))}
                ELSE '0%' END || ',SEXUAL=0%,VIOLENCE=0%' AS content FROM ({own})""",
        "verdict_reasons": f"""SELECT request_id, policy_id, {_explain("reason")} AS reason,
            {_explain("advice")} AS advice FROM ({own})""",
        "redacted_prompts": f"""SELECT request_id, policy_id, decision, md5(redacted_prompt) AS digest,
            length(redacted_prompt) AS chars FROM ({wide})""",
        "decisions_by_policy": f"""SELECT policy_id, context, decision, recommended_action, count(*) AS n,
            sum(injection_score::DECIMAL(18,2)) AS sum_injection FROM ({own}) GROUP BY ALL""",
        "decisions_rollup": f"""SELECT policy_id, context, app_id, count(*) AS n,
            count(*) FILTER (WHERE decision = 'block') AS blocked,
            count(*) FILTER (WHERE decision = 'redact') AS redacted,
            (3 - bit_count(grouping_id(policy_id, context, app_id)))::BIGINT AS level
            FROM ({own}) GROUP BY ROLLUP (policy_id, context, app_id)""",
        "policy_matrix": f"SELECT request_id, policy_id, context, decision, escalated FROM ({matrix})",
        "match_counts": f"""SELECT policy_id, category, type, count(*) AS n
            FROM ({_exploded_matches(matrix, "policy_id")}) GROUP BY ALL""",
        "score_summary": _with("v", matrix, f"""SELECT policy_id, panel, name, count(*) AS n,
            sum(score::DECIMAL(18,2)) AS sum_score, max(score) AS max_score
            FROM ({_SCORE_ROWS}) GROUP BY ALL"""),
        "eval_gate": f"""SELECT event_type, count(*) AS cases,
            count(*) FILTER (WHERE decision = expected) AS verified,
            count(*) = count(*) FILTER (WHERE decision = expected) AS passed
            FROM (SELECT event_type, decision, CASE
                WHEN event_id % {WL.PHRASE_KEYS} IN {WL.EXPECTED_DEFAULT["block"]} THEN 'block'
                WHEN event_id % {WL.PHRASE_KEYS} IN {WL.EXPECTED_DEFAULT["redact"]} THEN 'redact'
                ELSE 'allow' END AS expected
              FROM ({judged(f"SELECT * REPLACE ('default' AS policy_id) FROM ({TRAFFIC})")}))
            GROUP BY 1""",
        "audit_daily_volume": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, app_id, count(*) AS n,
            count(*) FILTER (WHERE decision = 'block') AS blocked FROM ({audit()}) GROUP BY 1, 2""",
        "audit_recent": f"""SELECT request_id, prompt, policy_id, decision, {_TS} AS ts FROM (
            SELECT * FROM ({audit()}) ORDER BY ts DESC, request_id DESC LIMIT 200)""",
        "audit_by_id": _with("a", audit(), f""", v AS (SELECT *, {_explain("reason")} AS reason,
                {_explain("advice")} AS advice FROM a WHERE request_id = 'ev-50')
            SELECT request_id, policy_id, app_id, context, prompt, decision, recommended_action,
                reason, advice, replay_of, {_TS} AS ts FROM v"""),
        "audit_replays_of": f"""SELECT request_id, policy_id, decision, replay_of FROM ({audit()})
            WHERE replay_of = 'ev-0'""",
        "audit_with_replays": _with("a", audit(), """SELECT o.request_id, o.decision,
            r.request_id AS replay_id, r.policy_id AS replay_policy, r.decision AS replay_decision
            FROM a o LEFT JOIN a r ON r.replay_of = o.request_id"""),
        "replay_pairs": f"""{pairs} SELECT request_id, replay_id, from_policy, to_policy, from_decision,
            to_decision, from_decision <> to_decision AS changed, {first_only("rm", "om")} AS gained,
            {first_only("om", "rm")} AS lost,
            (ri::DECIMAL(5,2) - oi::DECIMAL(5,2))::DECIMAL(5,2) AS delta_injection FROM p""",
        "replay_transitions": f"""{pairs} SELECT from_policy, to_policy, from_decision, to_decision,
            count(*) AS n, from_decision <> to_decision AS changed FROM p GROUP BY ALL""",
        "replay_transition_matrix": f"""{pairs} SELECT from_policy, to_policy, from_decision,
            count(*) FILTER (WHERE to_decision = 'allow') AS allow,
            count(*) FILTER (WHERE to_decision = 'redact') AS redact,
            count(*) FILTER (WHERE to_decision = 'block') AS block FROM p GROUP BY 1, 2, 3""",
        "replay_whatif": _with("a", audit(), f""", w AS ({judged(
            "SELECT request_id AS rid, prompt, NULL::VARCHAR AS policy_id, policy_id AS from_policy, "
            "decision AS from_decision FROM a", every_policy=True)})
            SELECT from_policy, policy_id AS to_policy, from_decision, decision AS to_decision,
                count(*) AS n, from_decision <> decision AS changed FROM w GROUP BY ALL"""),
        "replay_requested": f"""WITH asked AS ({_REPLAY_REQUESTS}), o AS ({judged(TRAFFIC)}),
            n AS ({judged(f"SELECT * REPLACE ('strict' AS policy_id) FROM ({TRAFFIC})")})
            SELECT md5('replay:all:' || o.request_id || ':strict') AS request_id, o.request_id AS replay_of,
                'strict' AS policy_id, n.decision,
                CASE WHEN o.user_id % 50 = 0 THEN 'retry' ELSE o.app_id END AS app_id, o.context,
                o.decision <> n.decision AS changed
            FROM asked JOIN o USING (request_id) JOIN n USING (request_id)""",
        "replay_outcomes": f"""WITH asked AS (
                SELECT CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 6 = 0 THEN 'lost-' || event_id
                        ELSE 'ev-' || event_id END AS request_id,
                    CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 11 = 0 THEN 'ghost'
                        ELSE 'strict' END AS policy_id
                FROM events WHERE event_type = 'purchase'),
            n AS (SELECT request_id, decision FROM
                ({judged(f"SELECT * REPLACE ('strict' AS policy_id) FROM ({TRAFFIC})")})),
            k AS (SELECT request_id FROM ({TRAFFIC}) WHERE coalesce(policy_id, 'default') <> 'ghost'),
            s AS (SELECT a.*, k.request_id IS NULL AS missing,
                    CASE WHEN a.request_id IS NULL OR a.policy_id = '' THEN 400
                        WHEN k.request_id IS NULL OR a.policy_id <> 'strict' THEN 404 ELSE 200 END AS status
                FROM asked a LEFT JOIN k ON a.request_id = k.request_id)
            SELECT s.request_id, policy_id, status::BIGINT AS status, CASE status WHEN 200 THEN 'OK'
                    WHEN 400 THEN 'Validation failed' ELSE 'Not Found' END AS title,
                CASE WHEN status = 404 THEN CASE WHEN missing
                    THEN 'Audit record not found: ''' || s.request_id || ''''
                    ELSE 'Unknown policy: ''' || policy_id || '''' END END AS detail,
                CASE WHEN status = 200 THEN md5('replay:asked:' || s.request_id || ':strict') END AS replay_id,
                CASE WHEN status = 200 THEN n.decision END AS decision
            FROM s LEFT JOIN n ON s.request_id = n.request_id""",
        "verify_outcomes": f"""WITH o AS MATERIALIZED ({_VERIFIED}), v AS (SELECT request_id, decision FROM
                ({judged(f"SELECT f.* FROM ({FAULTY}) f JOIN o USING (request_id) WHERE o.status = 200")}))
            SELECT o.request_id, status, title, detail, v.decision
            FROM o LEFT JOIN v ON o.request_id = v.request_id""",
        "verify_assessed": f"""WITH o AS MATERIALIZED ({_OUTCOMES}), v AS (SELECT request_id, decision FROM
                ({_fail_closed(f"SELECT f.* FROM ({FAULTY}) f JOIN o USING (request_id) WHERE o.status = 200")}))
            SELECT o.request_id, status, title, detail, v.decision
            FROM o LEFT JOIN v ON o.request_id = v.request_id""",
        "stream_audit": f"SELECT request_id, policy_id, decision, app_id FROM ({judged(TRAFFIC)})",
        "rl_disabled": f"""SELECT true AS allowed, NULL::VARCHAR AS scope, count(*) AS n
            FROM ({TRAFFIC})""",
        "val_replay_issues": f"""WITH r AS (SELECT CASE WHEN event_id % 3 = 0 THEN ''
                    WHEN event_id % 7 <> 0 THEN 'ev-' || event_id END AS r,
                CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 4 <> 0 THEN 'strict' END AS p FROM events)
            SELECT path, CASE WHEN v IS NULL THEN {q(V.REQUIRED)} ELSE {q(V.TOO_SHORT)} END AS message,
                count(*) AS n
            FROM (SELECT 'requestId' AS path, r AS v FROM r UNION ALL SELECT 'policyId', p FROM r)
            WHERE v IS NULL OR v = '' GROUP BY 1, 2""",
        "policy_document_issues": """SELECT
                CASE WHEN c_custkey % 19 <> 0 THEN 'p-' || c_custkey END AS id, c_name AS description,
                array_to_string(list_filter([
                    CASE WHEN c_custkey % 19 = 0 THEN 'id' END,
                    CASE WHEN c_custkey % 7 = 0 THEN 'guardrailId' END,
                    CASE WHEN c_custkey % 5 = 0 THEN 'promptInjection.mode' END,
                    CASE WHEN c_custkey % 120 > 100 THEN 'promptInjection.threshold' END,
                    CASE WHEN c_custkey % 11 = 0 THEN 'redactionStyle' END],
                    lambda x: x IS NOT NULL), ',') AS issues FROM customer""",
        "replay_missing": f"""SELECT request_id, 'Audit record not found: ''' || request_id || '''' AS detail
            FROM ({_REPLAY_REQUESTS}) WHERE request_id NOT IN (SELECT request_id FROM ({TRAFFIC})
                WHERE coalesce(policy_id, 'default') <> 'ghost')""",
        "latency_percentiles": f"""WITH a AS (SELECT *, NULL AS replay_of FROM ({TRAFFIC})
                WHERE coalesce(policy_id, 'default') <> 'ghost'), l AS ({_LATENCY})
            SELECT leg, count(*) AS n, {percentile(0.5)} AS p50, {percentile(0.95)} AS p95,
                {percentile(0.99)} AS p99 FROM l GROUP BY leg""",
        "rl_identity": f"SELECT request_id, client_id, ip FROM ({TRAFFIC})",
        "rl_tiers": f"""SELECT scope, lim::BIGINT AS "limit", win::BIGINT AS "window", count(*) AS requests,
            min(bucket) AS first_bucket, max(bucket) AS last_bucket FROM ({tiers(TRAFFIC)})
            GROUP BY 1, 2, 3""",
        "rate_counters": f"""SELECT counter || '#' || bucket AS counter_key, scope, count(*) AS used,
            (bucket + 1) * win AS expires_at FROM ({tiers(TRAFFIC)}) GROUP BY counter, bucket, scope, win""",
        "rl_denials": denials(TRAFFIC),
        "rl_sliding": f"""SELECT request_id, ip FROM (SELECT request_id, ip, epoch_us(ts) AS us,
                lag(epoch_us(ts), {_L.throttle_limit}) OVER (PARTITION BY ip ORDER BY ts, request_id) AS earlier
            FROM ({TRAFFIC})) WHERE us - earlier <= {_L.throttle_seconds * 1_000_000}""",
        "stream_screen": f"""SELECT request_id, policy_id, decision, {_explain("reason")} AS reason,
            redacted_prompt FROM ({judged(TRAFFIC)})""",
        "stream_decision_counts": f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f')
                AS window_start, policy_id, decision, count(*) AS n
            FROM ({judged(TRAFFIC)}) GROUP BY 1, 2, 3""",
        "stream_rate_limit": f"""SELECT t.request_id, d.request_id IS NULL AS allowed, d.scope,
            d.retry_after_seconds, false AS late
            FROM ({TRAFFIC}) t LEFT JOIN ({denials(TRAFFIC)}) d ON t.request_id = d.request_id""",
        "stream_late_counts": f"""WITH a AS MATERIALIZED ({_ARRIVALS}), m AS (
                SELECT slot, max(max(epoch_us(ts))) OVER (
                    ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
                FROM a GROUP BY slot), v AS (SELECT request_id AS id, decision, policy_id AS policy FROM ({judged(TRAFFIC)}))
            SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start,
                v.policy AS policy_id, decision, coalesce(((epoch_us(ts) // 3600000000 + 1) * 3600 + 86400) * 1000000
                    <= m.newest, false) AS late, count(*) AS n
            FROM a JOIN m USING (slot) JOIN v ON v.id = a.request_id GROUP BY ALL""",
        "stream_rate_limit_batches": delivered(_ARRIVALS),
        "stream_rate_limit_shared": f"""SELECT request_id, scope IS NULL AS allowed, scope,
            retry_after_seconds, false AS late FROM ({delivered(f"SELECT *, event_id % 3 AS slot, NULL::BIGINT AS horizon FROM ({TRAFFIC})")})""",
    }


def _fail_closed(requests: str) -> str:
    """Verdicts from the stored assessments; requests without one are refused."""
    sec = "list_filter(list_concat(managed_secrets, custom_secrets), lambda x: x.detected)"
    pii = "list_filter(g_pii, lambda x: x.detected)"
    topics = "list_filter(g_topics, lambda x: x.detected)"
    content = "list_filter(g_content, lambda x: x.detected AND x.type <> 'PROMPT_ATTACK')"
    attack = "list_filter(g_content, lambda x: x.detected AND x.type = 'PROMPT_ATTACK')"
    end = (
        "CASE WHEN strpos(normalized, x.match) > 0 THEN "
        + _span("x.match")[1]
        + " ELSE 0 END"
    )
    ends = lambda hits: f"coalesce(list_sum(list_transform({hits}, lambda x: {end})), 0)"
    first = lambda hits: f"{hits}[1].type"
    reasons = " ".join(
        f"WHEN len({hits}) > 0 THEN {text}"
        for hits, text in (
            (sec, f"'A secret was detected (' || {first(sec)} || ').'"),
            (pii, f"'Personal data was detected (' || {first(pii)} || ').'"),
        )
    )
    return f"""
WITH g AS ({ASSESSED}), v AS ({judged(requests)}),
j AS (SELECT v.*, g.event_id IS NOT NULL AS assessed, {sec} AS sec, {pii} AS hits, {topics} AS tops,
        {content} AS cont, {attack} AS atk, {ends(sec)} + {ends(pii)} AS span_ends
      FROM (SELECT event_id, request_id, normalized, conf, obf, mode, fired FROM v) v
      LEFT JOIN (SELECT event_id AS gid, * FROM g) g ON v.event_id = g.gid),
d AS (SELECT *, CASE WHEN len(sec) > 0 OR (len(atk) > 0 AND atk[1].action = 'BLOCKED')
            OR (fired AND mode = 'block')
            OR len(list_filter(tops, lambda x: x.action = 'BLOCKED')) > 0
            OR len(list_filter(cont, lambda x: x.action = 'BLOCKED')) > 0 THEN 'block'
        WHEN len(hits) > 0 THEN 'redact' ELSE 'allow' END AS decision FROM j)
SELECT request_id, CASE WHEN assessed THEN 200 ELSE 503 END::BIGINT AS status,
    CASE WHEN assessed THEN decision END AS decision,
    CASE WHEN NOT assessed THEN {q(V.GUARDRAIL_DOWN)}
         WHEN decision = 'allow' THEN {q(ALLOWED[0])}
         WHEN len(sec) > 0 THEN 'A secret was detected (' || sec[1].type || ').'
         WHEN len(hits) > 0 THEN 'Personal data was detected (' || hits[1].type || ').'
         WHEN len(atk) > 0 OR fired THEN {q(REASON["prompt_injection"])}
         WHEN len(tops) > 0 THEN 'The prompt requests a denied topic (' || tops[1].type || ').'
         WHEN len(cont) > 0 THEN 'The prompt triggered the ' || cont[1].type || ' content filter.'
         END AS reason,
    CASE WHEN assessed THEN len(sec) + len(hits) + least(len(atk), 1) + fired::INT + len(tops)
        + len(cont) + (len(obf) > 0)::INT END AS matches,
    CASE WHEN assessed THEN span_ends END::BIGINT AS span_ends,
    CASE WHEN assessed AND decision = 'redact' THEN md5({mask("normalized", "hits", "'{'", "'}'")}) END
        AS redacted
FROM d"""
