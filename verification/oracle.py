"""DuckDB texts that state independently what each query must return.

They are written for clarity, not speed: the lexicon is joined with every text, tokens
are lists, and windows do what the Spark side does by counting.
"""

from __future__ import annotations

from triagelens import constants as K
from triagelens.operators.metrics import sweep_thresholds
from verification.stem_sql import stem_ctes
from triagelens.profiles import CPU, FULL, LIVE, LIVE_FORM, AuditProfile
from triagelens.sources.views import CHANNELS, PHRASES, PRIORITIES

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
NOT_WS = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORDS = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def num(x: float) -> str:
    return repr(float(x)) if "e" in repr(float(x)) else repr(float(x)) + "e0"


def case(expr: str, mapping: dict, default: str = "NULL", key=q, value=str) -> str:
    arms = " ".join(f"WHEN {key(k)} THEN {value(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


def deal(values, index: str) -> str:
    return case(index, dict(enumerate(values)), key=str, value=q)


def clean(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), "
        f"'https?://{NOT_WS}+', ' ', 'g'), '{WS}+', ' ', 'g'))"
    )


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def domain(x: str) -> str:
    return f"lower(coalesce(nullif(regexp_extract({x}, '@([\\p{{L}}\\p{{N}}_.]+)', 1), ''), 'unknown'))"


def enterprise(x: str) -> str:
    return f"(CASE WHEN {x} IN ({', '.join(map(q, K.FREE_MAIL_DOMAINS))}) THEN 0 ELSE 1 END)"


def level_of(x: str, default: str = "NULL") -> str:
    return case(f"lower({strip(x)})", K.PRIORITY_LEVEL, default)


def label_of(x: str) -> str:
    return case(x, K.LEVEL_LABEL, key=str, value=q)


def clip(x: str) -> str:
    return f"cast(least(greatest(round_even({x}, 0), 1), 4) AS INTEGER)"


RAW = f"""tickets AS MATERIALIZED (
  SELECT 'T' || lpad(cast(e.event_id AS VARCHAR), 8, '0') AS ticket_id,
    {deal(PHRASES, 'e.event_id % 12')} AS ticket_subject,
    {deal(PHRASES, 'cast(floor(e.event_id / 12.0) AS BIGINT) % 12')} || '. ' || d.text AS ticket_description,
    {deal(PRIORITIES, 'e.event_id % 7')} AS ticket_priority,
    {deal(CHANNELS, 'e.user_id % 8')} AS ticket_channel,
    e.event_type AS ticket_type,
    CASE e.user_id % 3 WHEN 0 THEN 'u' || cast(e.user_id AS VARCHAR) || '@gmail.com'
      WHEN 1 THEN 'u' || cast(e.user_id AS VARCHAR) || '@My-Corp.example.com' END AS customer_email,
    CASE WHEN e.event_id % 11 <> 0 THEN e.value END AS resolution_hours
  FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""


def norm(source: str = "tickets", name: str = "n") -> str:
    return f"""{name}0 AS (
  SELECT ticket_id, {clean('ticket_subject')} AS ticket_subject,
    {clean('ticket_description')} AS ticket_description, ticket_priority,
    coalesce(ticket_channel, 'Unknown') AS ticket_channel,
    coalesce(ticket_type, 'Unknown') AS ticket_type,
    coalesce(customer_email, 'user@unknown.com') AS customer_email, resolution_hours,
    {level_of('ticket_priority')} AS priority_numeric
  FROM {source}),
{name} AS MATERIALIZED (
  SELECT *, {domain('customer_email')} AS customer_domain,
    {enterprise(domain('customer_email'))} AS is_enterprise
  FROM {name}0 WHERE priority_numeric IS NOT NULL)"""


LIVE_REQUESTS = f"""lr AS MATERIALIZED (
  SELECT ticket_id, {strip('ticket_subject')} AS ticket_subject,
    {strip('ticket_description')} AS ticket_description,
    {strip("coalesce(ticket_priority, 'Medium')")} AS ticket_priority,
    {strip("coalesce(ticket_channel, 'Email')")} AS ticket_channel,
    coalesce(resolution_hours, 0e0) AS resolution_hours,
    {level_of("coalesce(ticket_priority, 'Medium')", '2')} AS priority_numeric
  FROM tickets)"""


def rules(profile: AuditProfile, source: str = "n", name: str = "r") -> str:
    """CTEs ending in ``name``: all columns of the source plus the rule columns."""
    p = profile.rules
    rows, i = [], 0
    for tier, phrases in p.tiers.items():
        for phrase in phrases:
            rows.append(f"({q(tier)}, {i}, {q(phrase)}, {lst(phrase.split())})")
            i += 1
    points = " ".join(
        f"{'-' if K.TIER_POINTS[t] < 0 else '+'} n_{t} * {num(abs(K.TIER_POINTS[t]))}"
        for t in p.tiers)[2:]
    counts = ", ".join(f"coalesce(len(c_{t}), 0)::DOUBLE AS n_{t}" for t in p.tiers)
    hits = ", ".join(
        f"list(phrase ORDER BY ord) FILTER (tier = '{t}' AND NOT neg) AS c_{t}, "
        f"list(phrase ORDER BY ord) FILTER (tier = '{t}' AND neg) AS x_{t}" for t in p.tiers)
    boost = " + ".join(f"contains(text, {q(w)})::INT" for w in p.intensifiers)
    weight = case(f"lower({strip('ticket_channel')})", p.channel_weight, "1e0", value=num)

    def parts(spec, letter):
        heads = []
        for tiers, cap in spec:
            joined = "[]::VARCHAR[]"
            for t in tiers:
                joined = f"list_concat({joined}, coalesce({letter}_{t}, []::VARCHAR[]))"
            heads.append(f"({joined})[1:{cap}]")
        out = "[]::VARCHAR[]"
        for h in heads:
            out = f"list_concat({out}, {h})"
        return out

    negated = "(" + " OR ".join(f"contains(before, {q(g)})" for g in p.negations) + ")"
    medium = "raw >= 0.5e0"
    if p.positive_is_medium:
        medium += " OR (raw > 0 AND n_low = 0)"
    reported = "raw" if p.raw_decimals is None else f"round(raw, {p.raw_decimals})"
    return f"""{name}lex(tier, ord, phrase, kws) AS (VALUES {', '.join(rows)}),
{name}txt AS MATERIALIZED (
  SELECT ticket_id, lower(ticket_subject || ' ' || ticket_description) AS text,
    string_split_regex(lower(ticket_subject || ' ' || ticket_description), '{NOT_WORD}+') AS words
  FROM {source}),
{name}tok AS (
  SELECT ticket_id, unnest(words) AS tok, generate_subscripts(words, 1) AS pos FROM {name}txt),
{name}cand AS (SELECT k.ticket_id, k.pos, l.* FROM {name}tok k JOIN {name}lex l ON l.kws[1] = k.tok),
{name}pos AS (
  SELECT c.ticket_id, c.tier, c.ord, c.phrase, min(c.pos) AS pos
  FROM {name}cand c JOIN {name}txt t USING (ticket_id)
  WHERE contains(t.text, c.phrase) AND t.words[c.pos:c.pos + len(c.kws) - 1] = c.kws GROUP BY ALL),
{name}win AS (
  SELECT p.*, array_to_string(t.words[greatest(1, p.pos - 5):p.pos - 1], ' ') AS before
  FROM {name}pos p JOIN {name}txt t USING (ticket_id)),
{name}hit AS (SELECT ticket_id, tier, ord, phrase, {negated} AS neg FROM {name}win),
{name}agg AS (SELECT ticket_id, {hits} FROM {name}hit GROUP BY ticket_id),
{name}cnt AS (
  SELECT s.*, t.text, {boost} AS rule_intensifiers, {counts},
    {', '.join(f'c_{t}, x_{t}' for t in p.tiers)}
  FROM {source} s JOIN {name}txt t USING (ticket_id) LEFT JOIN {name}agg USING (ticket_id)),
{name}raw AS (
  SELECT *, ({points} + rule_intensifiers::DOUBLE * 0.5e0) * {weight} AS raw FROM {name}cnt),
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN n_critical >= 2 OR raw >= 5e0 THEN 4 WHEN n_critical = 1 OR raw >= 2.5e0 THEN 3
      WHEN {medium} THEN 2 ELSE 1 END AS severity_rules,
    {parts(p.matched_parts, 'c')} AS rule_keywords, {parts(p.negated_parts, 'x')} AS rule_negated,
    {reported} AS rule_raw
  FROM {name}raw)"""


def default_level(h: str, live: bool = False) -> str:
    unknown = f"{h} IS NULL" + (f" OR {h} <= 0" if live else "")
    return (f"CASE WHEN {unknown} THEN 2 WHEN {h} <= 24 THEN 1 WHEN {h} <= 72 THEN 2 "
            f"WHEN {h} <= 168 THEN 3 ELSE 4 END")


def substring_count(words) -> str:
    return " + ".join(f"contains(text, {q(w)})::INT" for w in words)


HEURISTIC_POSITION = "coalesce(" + ", ".join(
    f"nullif(instr(text, {q(w)}), 0)" for w in K.HEURISTIC_CRITICAL + K.HEURISTIC_HIGH) + ")"


def cut(text: str, position: str, before: int, after: str) -> str:
    start = f"greatest({position} - {before}, 1)"
    return strip(f"substring({text}, {start}, {position} + {after} - {start})")


HEURISTIC = f"""h0 AS (SELECT *, {substring_count(K.HEURISTIC_CRITICAL)} AS hc,
    {substring_count(K.HEURISTIC_HIGH)} AS hh, {substring_count(K.HEURISTIC_LOW)} AS hl,
    {HEURISTIC_POSITION} AS hp FROM
    (SELECT *, lower(ticket_subject || ' ' || ticket_description) AS text FROM n)),
h AS MATERIALIZED (SELECT ticket_id, CASE WHEN hc >= 2 THEN 4 WHEN hc = 1 OR hh >= 2 THEN 3
    WHEN hh = 1 THEN 2 WHEN hl >= 1 THEN 1 ELSE 2 END AS severity_llm,
    CASE WHEN hp IS NOT NULL
      THEN {cut("(ticket_subject || ' ' || ticket_description)", 'hp', 20, '50')}
      ELSE substring(ticket_subject, 1, 80) END AS llm_reason FROM h0)"""


def fused(profile: AuditProfile, source: str, name: str = "f") -> str:
    total = " + ".join(f"{num(w)} * {s}" for s, w in profile.fusion.items())
    return f"""{name}0 AS (SELECT *, {clip(total)} AS severity_fused FROM {source}),
{name} AS MATERIALIZED (SELECT *, severity_fused - priority_numeric AS severity_delta,
    {label_of('severity_fused')} AS inferred_severity_label,
    CASE WHEN abs(severity_fused - priority_numeric) >= 2 THEN 1 ELSE 0 END AS mismatch,
    CASE WHEN abs(severity_fused - priority_numeric) < 2 THEN 'Consistent'
      WHEN severity_fused > priority_numeric THEN 'Hidden Crisis' ELSE 'False Alarm' END AS mismatch_type,
    abs(severity_fused - priority_numeric) / 4e0 AS mismatch_confidence
  FROM {name}0)"""


def labelled(profile: AuditProfile, llm: str = "proxy") -> str:
    head = [RAW, norm(), rules(profile)]
    if llm == "heuristic":
        head.append(HEURISTIC)
        signal = "h.severity_llm, h.llm_reason"
        join = "JOIN h USING (ticket_id)"
    else:
        signal, join = "severity_rules AS severity_llm, '' AS llm_reason", ""
    head.append(f"""s AS (SELECT r.*, {signal}, {default_level('resolution_hours')} AS severity_resolution,
    severity_rules AS severity_cluster FROM r {join})""")
    head.append(fused(profile, "s"))
    return ",\n".join(head)


def live(profile: AuditProfile) -> str:
    return ",\n".join([
        RAW, LIVE_REQUESTS, rules(profile, "lr"),
        f"""s AS (SELECT *, {default_level('resolution_hours', True)} AS severity_resolution,
    severity_rules AS severity_cluster FROM r)""", fused(profile, "s")])


def signed(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '+' END || abs({x})::VARCHAR)"


def pipe(x: str) -> str:
    return f"array_to_string({x}, '|')"


SQL: dict[str, str] = {}


def put(name: str, ctes: str, body: str) -> None:
    SQL[name] = f"WITH {ctes}\n{body}" if ctes else body


BATCH = f"{RAW}, {norm()}"
_RULE_COLUMNS = (f"ticket_id, severity_rules, {pipe('rule_keywords')} AS keywords, "
                 f"{pipe('rule_negated')} AS negated, round(rule_raw, 6) AS raw, rule_intensifiers")

# ------------------------------------------------------------- normalisation
put("clean_text", "", f"SELECT page_id, {clean('html')} AS cleaned FROM pages")
put("normalise_tickets", BATCH, """SELECT ticket_id, ticket_subject, ticket_description, ticket_priority,
  ticket_channel, ticket_type, customer_email, resolution_hours, priority_numeric, customer_domain,
  is_enterprise, (length(ticket_subject) + 2 + length(ticket_description))::INTEGER AS full_text_chars FROM n""")
put("normalise_conversations", f"""tickets AS (
  SELECT lpad(conv_id::VARCHAR, 8, '0') || '-' || turn::VARCHAR AS ticket_id,
    'conversation turn ' || turn::VARCHAR AS ticket_subject, text AS ticket_description,
    {deal(PRIORITIES, '(conv_id + turn) % 7')} AS ticket_priority, {deal(CHANNELS, 'conv_id % 8')} AS ticket_channel,
    'topic ' || (conv_id % 5)::VARCHAR AS ticket_type, 'c' || conv_id::VARCHAR || '@desk.example.org' AS customer_email,
    CASE WHEN conv_id % 9 <> 0 THEN ((conv_id * 37 + turn) % 240)::DOUBLE END AS resolution_hours
  FROM conversations WHERE role = 'user'),
{norm()}""", """SELECT ticket_id, ticket_subject, ticket_description, ticket_channel, ticket_type,
  customer_domain, is_enterprise, resolution_hours, priority_numeric FROM n""")
put("csv_tickets", BATCH, """SELECT ticket_id, md5(ticket_subject || '. ' || ticket_description) AS text_md5,
  ticket_channel, customer_email, resolution_hours, priority_numeric FROM n""")
put("row_ids", "", """SELECT count(*) AS n, 'T' || lpad('0', 6, '0') AS first_id,
  'T' || lpad((count(*) - 1)::VARCHAR, 6, '0') AS last_id, count(*) AS n_distinct FROM events""")
put("rejected_priorities", RAW, f"""SELECT ticket_priority, count(*) AS n_rejected FROM tickets
  WHERE {level_of('ticket_priority')} IS NULL GROUP BY 1""")
put("domain_enterprise", RAW, f"""SELECT ticket_id, d AS customer_domain, {enterprise('d')} AS is_enterprise
  FROM (SELECT ticket_id, {domain("coalesce(customer_email, 'user@unknown.com')")} AS d FROM tickets)""")
put("priority_distribution", BATCH, "SELECT ticket_priority, count(*) AS n FROM n GROUP BY 1")
put("severity_labels", "", f"""SELECT event_id, {label_of('l')} AS label, {level_of('event_type', '2')} AS level_of_type,
  l AS level_of_label FROM (SELECT *, {clip('value / 20e0')} AS l FROM events)""")

# -------------------------------------------------------------------- rules
for _name, _profile in (("rules_full", FULL), ("rules_cpu", CPU)):
    put(_name, f"{BATCH}, {rules(_profile)}", f"SELECT {_RULE_COLUMNS} FROM r")
for _name, _profile in (("rules_live", LIVE), ("rules_live_form", LIVE_FORM)):
    put(_name, f"{RAW}, {LIVE_REQUESTS}, {rules(_profile, 'lr')}", f"SELECT {_RULE_COLUMNS} FROM r")
_FULL_RULES = f"{BATCH}, {rules(FULL)}"
put("rule_distribution", _FULL_RULES, """SELECT severity_rules, count(*) AS n,
  round(avg(rule_raw), 6) AS mean_raw FROM r GROUP BY 1""")
put("negated_keywords", _FULL_RULES, """SELECT phrase, count(*) AS n FROM
  (SELECT unnest(rule_negated) AS phrase FROM r) GROUP BY 1""")


def context(top: str, lead: int) -> str:
    original = "(ticket_subject || ' ' || ticket_description)"
    position = f"instr(text, {top})"
    return f"'…' || {cut(original, position, lead, f'(length({top}) + 50)')} || '…'"


put("evidence_snippets", _FULL_RULES, f"""SELECT ticket_id, rule_keywords[1] AS phrase,
  {context('rule_keywords[1]', 30)} AS full_snippet, {context('rule_keywords[1]', 20)} AS cpu_snippet,
  substring(ticket_subject, 1, 100) AS full_missing, 'no such phrase' AS cpu_missing
  FROM r WHERE len(rule_keywords) > 0""")

# ---------------------------------------------------------------- zero-shot
_PROMPT = q(K.PROMPT.replace("{{", "{").replace("}}", "}"))
for _i, _value in enumerate(("substring(ticket_subject, 1, 300)", "substring(ticket_description, 1, 800)",
                             "ticket_channel", "ticket_type")):
    _PROMPT = _PROMPT.replace(f"{{{_i}}}", f"' || {_value} || '")
put("prompt_text", BATCH, f"SELECT ticket_id, {_PROMPT} AS prompt FROM n")
put("parse_model_json", "e AS (SELECT *, (json_extract(props, '$.k'))::INT AS k FROM events)", """
  SELECT event_id, CASE WHEN event_id % 6 IN (0, 1) THEN least(greatest(k % 7, 1), 4)
    WHEN event_id % 6 = 4 THEN 2 WHEN event_id % 6 = 5 THEN least(greatest(k % 5, 1), 4) END AS severity,
    CASE WHEN event_id % 6 IN (0, 1) THEN 'seen ' || event_type WHEN event_id % 6 = 4 THEN 'no level given'
    WHEN event_id % 6 = 5 THEN '' END AS reason FROM e""")
put("heuristic_severity", f"{BATCH}, {HEURISTIC}", "SELECT ticket_id, severity_llm, llm_reason FROM h")
put("custom_scorer", f"""{BATCH}, {HEURISTIC},
pl AS (SELECT ticket_id, length({_PROMPT}) AS c FROM n)""", """SELECT ticket_id,
  CASE WHEN c % 6 = 5 THEN h.severity_llm ELSE least(greatest(c % 6, 1), 4)::INTEGER END AS severity_llm,
  CASE WHEN c % 6 = 5 THEN h.llm_reason ELSE 'length ' || c::VARCHAR END AS llm_reason
  FROM pl JOIN h USING (ticket_id)""")
SQL["stored_scorer"] = SQL["custom_scorer"]

# --------------------------------------------------------------- resolution
put("tfidf_weights", f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}{{2,}}') AS t FROM documents),
g AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM w),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
v AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2
  ORDER BY cf DESC, term LIMIT 500),
x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w
  FROM tf JOIN v USING (term))""", """SELECT doc_id, term,
  round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
put("label_encode", "", """SELECT doc_id, lang, source, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS lang_code,
  (dense_rank() OVER (ORDER BY source) - 1)::INTEGER AS source_code FROM documents""")
_HOURS = f"{RAW}, {norm()}"
put("resolution_quartiles", _HOURS, """SELECT count(resolution_hours) AS n_training,
  round(avg(ln(1 + resolution_hours)), 6) AS mean_log_hours,
  round(quantile_cont(resolution_hours, 0.25), 6) AS q25, round(quantile_cont(resolution_hours, 0.5), 6) AS q50,
  round(quantile_cont(resolution_hours, 0.75), 6) AS q75 FROM n""")
put("severity_fitted_bucket", f"""{_HOURS}, c AS (SELECT quantile_cont(resolution_hours, 0.25) AS a,
  quantile_cont(resolution_hours, 0.5) AS b, quantile_cont(resolution_hours, 0.75) AS c FROM n)""",
    """SELECT ticket_id, CASE WHEN resolution_hours <= c.a THEN 1 WHEN resolution_hours <= c.b THEN 2
  WHEN resolution_hours <= c.c THEN 3 ELSE 4 END AS severity FROM n, c WHERE resolution_hours IS NOT NULL""")
put("severity_default_bucket", RAW, f"""SELECT ticket_id, {default_level('resolution_hours')} AS severity_batch,
  {default_level('resolution_hours', True)} AS severity_live,
  {default_level('(-resolution_hours)', True)} AS severity_live_negative FROM tickets""")
put("signal_distribution", labelled(CPU), """SELECT signal, level, count(*) AS n FROM (
  SELECT unnest(['severity_resolution', 'severity_rules', 'severity_cluster']) AS signal,
    unnest([severity_resolution, severity_rules, severity_cluster]) AS level FROM f) GROUP BY ALL""")

# ----------------------------------------------------------------- clusters
put("unit_vectors", """e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e)""",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(u[1], 5) AS first FROM u""")
put("nearest_centroid", """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label AS c, i, avg(x) AS m FROM e GROUP BY ALL),
d AS (SELECT e.vec_id, c.c, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (i) GROUP BY ALL),
k AS (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS r FROM d)""",
    "SELECT vec_id, label, c AS nearest FROM k JOIN embeddings USING (vec_id) WHERE r = 1")
_RANKED = """j AS (SELECT v.vec_id, v.label AS cluster, e.value AS h FROM embeddings v
  LEFT JOIN events e ON e.event_id = v.vec_id),
m AS (SELECT cluster, coalesce(median(h), 0) AS med FROM j GROUP BY cluster),
mf AS (SELECT *, row_number() OVER (ORDER BY med, cluster) - 1 AS r, count(*) OVER () AS n FROM m),
rf AS (SELECT cluster, med, least(greatest(floor(1 + r / greatest(n - 1, 1)::DOUBLE * 3), 1), 4)::INTEGER AS severity FROM mf),
mc AS (SELECT *, row_number() OVER (ORDER BY med, cluster) - 1 AS r, count(*) OVER () AS n FROM (
  SELECT i::INTEGER AS cluster, coalesce(med, 0) AS med FROM range(12) t(i) LEFT JOIN m ON m.cluster = i)),
rc AS (SELECT cluster, med, least(greatest(1 + round_even(r / greatest(n - 1, 1)::DOUBLE * 3, 0), 1), 4)::INTEGER AS severity FROM mc)"""
put("cluster_rank", _RANKED, """SELECT 'full' AS profile, cluster, round(med, 6) AS median_hours, severity FROM rf
  UNION ALL SELECT 'cpu', cluster, round(med, 6), severity FROM rc""")
put("cluster_severity", _RANKED, """SELECT vec_id, cluster, severity, 2 AS severity_unknown, 2 AS severity_unfitted
  FROM j JOIN rf USING (cluster)""")

# ------------------------------------------------------------------- fusion
_FUSED = """ticket_id, severity_resolution, severity_rules, severity_cluster, severity_fused,
  inferred_severity_label, severity_delta, mismatch, mismatch_type"""
_FULL_H = labelled(FULL, "heuristic")
put("fuse_full", _FULL_H, f"SELECT severity_llm, {_FUSED} FROM f")
put("fuse_cpu", labelled(CPU), f"SELECT {_FUSED} FROM f")
put("label_tickets", labelled(FULL), f"""SELECT ticket_id, ticket_priority, ticket_channel, ticket_type,
  resolution_hours, severity_llm, llm_reason, severity_fused, mismatch, mismatch_type,
  {pipe('rule_keywords')} AS keywords FROM f""")
_BREAKDOWN = """SELECT count(*) AS n_total, sum(mismatch)::BIGINT AS n_mismatch,
  round(avg(mismatch), 6) AS mismatch_rate, count(*) FILTER (mismatch_type = 'Hidden Crisis') AS hidden_crisis,
  count(*) FILTER (mismatch_type = 'False Alarm') AS false_alarm FROM f"""
put("mismatch_breakdown", labelled(CPU), _BREAKDOWN)
_PAIRS = [(a, b) for i, a in enumerate(K.FULL_FUSION) for b in list(K.FULL_FUSION)[i + 1:]]
put("signal_agreement", f"""{_FULL_H},
p AS ({' UNION ALL '.join(f"SELECT '{a}' AS signal_a, '{b}' AS signal_b, {a} AS a, {b} AS b FROM f" for a, b in _PAIRS)}),
ma AS (SELECT signal_a, signal_b, a AS v, count(*) AS n FROM p GROUP BY ALL),
mb AS (SELECT signal_a, signal_b, b AS v, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT signal_a, signal_b, count(*)::DOUBLE AS n, avg((a = b)::INT) AS po FROM p GROUP BY ALL),
pe AS (SELECT signal_a, signal_b, sum(ma.n / t.n * (mb.n / t.n)) AS pe FROM t JOIN ma USING (signal_a, signal_b)
  JOIN mb USING (signal_a, signal_b, v) GROUP BY ALL)""",
    """SELECT signal_a, signal_b, round((po - pe) / (1 - pe), 4) AS cohen_kappa, round(po, 4) AS raw_agreement
  FROM t JOIN pe USING (signal_a, signal_b)""")


def _ablation(profile: AuditProfile, agree: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{s}' AS signal, round(avg((abs({s} - priority_numeric) >= 2)::INT), 4) AS mismatch_rate,
  round(avg(({agree.format(s=s)})::INT), 4) AS agreement_with_fused FROM f""" for s in profile.fusion)


put("ablation_full", _FULL_H, _ablation(FULL, "{s} = severity_fused"))
put("ablation_cpu", labelled(CPU), _ablation(CPU, "(abs({s} - priority_numeric) >= 2) = (mismatch = 1)"))
put("signal_contribution", _FULL_H, " UNION ALL ".join(
    f"""SELECT '{s}' AS signal, round(avg((abs({s} - priority_numeric) >= 2)::INT) * 100, 4) AS percent_flagged
  FROM f WHERE mismatch = 1""" for s in K.FULL_FUSION))

# --------------------------------------------------------------- classifier
_BIN = """CASE WHEN resolution_hours IS NULL THEN 'unknown' WHEN resolution_hours < 0 THEN 'very_slow'
  WHEN resolution_hours < 24 THEN 'fast' WHEN resolution_hours < 72 THEN 'moderate'
  WHEN resolution_hours < 168 THEN 'slow' ELSE 'very_slow' END"""
put("model_text", BATCH, f"""SELECT ticket_id, {_BIN} AS time_bin, substring(ticket_subject, 1, 200) || ' ' ||
  substring(ticket_description, 1, 600) || ' channel:' || ticket_channel || ' type:' || ticket_type ||
  ' time:' || {_BIN} || ' enterprise:' || is_enterprise::VARCHAR AS model_text FROM n""")
_SIGNALS = ("resolution", "rules", "cluster", "fused")
put("numeric_features", labelled(CPU), f"""SELECT ticket_id,
  {', '.join(f'severity_{s}::DOUBLE AS severity_{s}' for s in _SIGNALS)}, priority_numeric::DOUBLE AS priority_numeric,
  {', '.join(f'(severity_{s} - priority_numeric)::DOUBLE AS delta_{s}' for s in _SIGNALS)},
  is_enterprise::DOUBLE AS is_enterprise, round(coalesce(resolution_hours, -1), 6) AS hours,
  round(rule_raw, 6) AS rule_raw, (dense_rank() OVER (ORDER BY ticket_channel) - 1)::DOUBLE AS channel_code,
  (dense_rank() OVER (ORDER BY ticket_type) - 1)::DOUBLE AS type_code FROM f""")


def unit(key: str, seed: int) -> str:
    return f"(('0x' || substring(md5('{seed}:' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296e0)"


put("hash_split", f"d AS (SELECT doc_id, {unit('doc_id', 42)} AS u FROM documents)",
    """SELECT doc_id, CASE WHEN u < 0.15e0 THEN 'test' WHEN u < 0.3e0 THEN 'validation' ELSE 'train' END AS split FROM d""")
_TRUTH = f"t AS (SELECT doc_id, toxic AS label, {unit('doc_id', 7)} AS score FROM labels)"
put("stratified_split", f"""{_TRUTH}, u AS (SELECT doc_id, label, {unit('doc_id', 42)} AS u FROM t),
c AS (SELECT label, quantile_cont(u, 0.15) AS a, quantile_cont(u, 0.3) AS b FROM u GROUP BY label)""",
    """SELECT doc_id, label, CASE WHEN u < a THEN 'test' WHEN u < b THEN 'validation' ELSE 'train' END AS split
  FROM u JOIN c USING (label)""")
put("class_weights", _TRUTH, """SELECT label, count(*) AS n_rows, round((SELECT count(*) FROM t) /
  ((SELECT count(DISTINCT label) FROM t) * count(*))::DOUBLE, 6) AS weight FROM t GROUP BY label""")


def f1(hit: str) -> str:
    return f"CASE WHEN 2 * {hit} + fp + fn = 0 THEN 0 ELSE 2 * {hit} / (2 * {hit} + fp + fn)::DOUBLE END"


_MACRO = (f"(({f1('tp')}) * (tp + fp + fn > 0)::INT + ({f1('tn')}) * (tn + fp + fn > 0)::INT) / "
          "((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT)")
_CUTS = ", ".join(f"({i}, {num(t)})" for i, t in enumerate(sweep_thresholds()))
put("threshold_sweep", f"""{_TRUTH}, c(i, th) AS (VALUES {_CUTS}),
x AS (SELECT i, th, count(*) FILTER (label = 1 AND score >= th) AS tp, count(*) FILTER (label = 0 AND score >= th) AS fp,
  count(*) FILTER (label = 1 AND score < th) AS fn, count(*) FILTER (label = 0 AND score < th) AS tn FROM t, c GROUP BY ALL),
y AS (SELECT i, th, {_MACRO} AS m FROM x)""", """SELECT round(th, 4) AS threshold, round(m, 6) AS macro_f1,
  m > 0 AND i = (SELECT i FROM y ORDER BY m DESC, i LIMIT 1) AS is_best FROM y""")
_CONFUSION = f"""{_TRUTH}, j AS (SELECT *, (score >= 0.5e0)::INT AS pred FROM t),
x AS (SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
  count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM j)"""


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 0 ELSE ({a}) / ({b})::DOUBLE END"


put("classifier_metrics", _CONFUSION, f"""SELECT round({ratio('tp + tn', '(tp + fp + fn + tn)')}, 6) AS accuracy,
  round({_MACRO}, 6) AS macro_f1, round({ratio('tn', '(tn + fp)')}, 6) AS recall_consistent,
  round({ratio('tp', '(tp + fn)')}, 6) AS recall_mismatch FROM x""")
put("classification_report", f"""{_CONFUSION}, y AS (SELECT *, {ratio('tn', '(tn + fn)')} AS p0, {ratio('tn', '(tn + fp)')} AS r0,
  {f1('tn')} AS f0, tn + fp AS n0, {ratio('tp', '(tp + fp)')} AS p1, {ratio('tp', '(tp + fn)')} AS r1, {f1('tp')} AS f1,
  tp + fn AS n1, tp + fp + fn + tn AS n FROM x)""", """SELECT 'Consistent' AS class, round(p0, 6) AS precision,
  round(r0, 6) AS recall, round(f0, 6) AS f1_score, n0 AS support FROM y
  UNION ALL SELECT 'Mismatch', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM y
  UNION ALL SELECT 'accuracy', round((tp + tn) / n::DOUBLE, 6), round((tp + tn) / n::DOUBLE, 6), round((tp + tn) / n::DOUBLE, 6), n FROM y
  UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM y
  UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / n, 6), round((r0 * n0 + r1 * n1) / n, 6),
    round((f0 * n0 + f1 * n1) / n, 6), n FROM y""")
put("quality_gate", f"""{_CONFUSION}, y AS (SELECT {ratio('tp + tn', '(tp + fp + fn + tn)')} AS a, {_MACRO} AS m,
  {ratio('tn', '(tn + fp)')} AS c, {ratio('tp', '(tp + fn)')} AS d FROM x),
z AS (SELECT a, list_filter([CASE WHEN a < 0.83e0 THEN 'accuracy' END, CASE WHEN m < 0.82e0 THEN 'macro_f1' END,
  CASE WHEN c < 0.78e0 THEN 'recall_consistent' END, CASE WHEN d < 0.78e0 THEN 'recall_mismatch' END],
  lambda s: s IS NOT NULL) AS failed FROM y)""",
    f"SELECT round(a, 6) AS accuracy, {pipe('failed')} AS failed, len(failed) = 0 AS passed FROM z")
put("fallback_confidence", labelled(CPU), """SELECT ticket_id, mismatch AS mismatch_pred,
  round(abs(severity_delta) / 3e0, 6) AS confidence_service, round(abs(severity_delta) / 4e0, 6) AS confidence_form,
  mismatch_type FROM f""")

# ------------------------------------------------------------------ dossiers
_KW_VALUE = ("CASE WHEN len(rule_keywords) > 0 THEN '''' || rule_keywords[1] || ''' found — context: \"' || "
             f"substring({context('rule_keywords[1]', 20)}, 1, 120) || '\"' END")
_KW_VALUE_FULL = ("CASE WHEN len(rule_keywords) > 0 THEN '''' || rule_keywords[1] || ''' found in ticket — context: \"' || "
                  f"substring({context('rule_keywords[1]', 30)}, 1, 120) || '\"' END")
put("evidence_keyword", labelled(CPU), f"""SELECT ticket_id, 'keyword' AS signal, {_KW_VALUE} AS value,
  '0.35' AS weight FROM f WHERE len(rule_keywords) > 0""")
_BASE = case("priority_numeric", K.BASELINE_HOURS, key=str, value=num)
_BASE_TEXT = case("priority_numeric", {k: str(int(v)) for k, v in K.BASELINE_HOURS.items()}, key=str, value=q)
_H1 = "printf('%.1f', resolution_hours)"
_LABEL = label_of("priority_numeric")
_RES_FULL = f"""CASE WHEN resolution_hours / {_BASE} >= 1.5e0 THEN 'Resolution took ' || {_H1} || 'h — ' ||
    printf('%.1f', resolution_hours / {_BASE}) || '× longer than the ' || {_BASE_TEXT} || 'h baseline for ' || {_LABEL} ||
    '-priority tickets. Indicates actual urgency exceeded label.'
  WHEN resolution_hours / {_BASE} <= 0.4e0 THEN 'Resolution took only ' || {_H1} || 'h — ' ||
    CASE WHEN resolution_hours = 0 THEN '' ELSE printf('%.1f', 1e0 / (resolution_hours / {_BASE})) || '× ' END ||
    'faster than the ' || {_BASE_TEXT} || 'h baseline for ' || {_LABEL} ||
    '-priority tickets. Suggests ticket was less severe than labeled.' END"""
_RES_CPU = f"""CASE WHEN resolution_hours > 0 AND resolution_hours / {_BASE} >= 1.5e0 THEN 'Resolution took ' || {_H1} || 'h — ' ||
    printf('%.1f', resolution_hours / {_BASE}) || '× above ' || {_BASE_TEXT} || 'h baseline for ' || {_LABEL} ||
    '-priority. Suggests true urgency exceeded assigned label.'
  WHEN resolution_hours > 0 AND resolution_hours / {_BASE} <= 0.4e0 THEN 'Resolved in just ' || {_H1} || 'h — far faster than ' ||
    {_BASE_TEXT} || 'h baseline for ' || {_LABEL} || '-priority. Suggests overvalued.' END"""
_RES_FULL_VALUE = f"{_H1} || ' hours (actual) vs. ' || {_BASE_TEXT} || 'h baseline'"
_RES_CPU_VALUE = f"{_H1} || 'h actual vs ' || {_BASE_TEXT} || 'h baseline'"
put("evidence_resolution", f"{BATCH}, x AS (SELECT *, {_RES_FULL} AS i FROM n)",
    f"""SELECT ticket_id, 'resolution_time' AS signal, {_RES_FULL_VALUE} AS value, i AS interpretation,
  '0.30' AS weight FROM x WHERE i IS NOT NULL""")
put("evidence_resolution_cpu", f"{BATCH}, x AS (SELECT *, {_RES_CPU} AS i FROM n)",
    f"""SELECT ticket_id, 'resolution_time' AS signal, {_RES_CPU_VALUE} AS value, i AS interpretation,
  '0.35' AS weight FROM x WHERE i IS NOT NULL""")
_URGENT = "lower(ticket_channel) IN ('social media', 'phone') AND severity_delta > 0"
_RELAXED = "lower(ticket_channel) IN ('web', 'portal') AND severity_delta < 0"
_CH_FULL_VALUE = f"""CASE WHEN {_URGENT} THEN 'Channel: ''' || lower(ticket_channel) || ''' — high-urgency intake path'
  WHEN {_RELAXED} THEN 'Channel: ''' || lower(ticket_channel) || ''' — self-service/low-urgency intake' END"""
_CH_FULL_TEXT = f"""CASE WHEN {_URGENT} THEN 'Tickets via ' || lower(ticket_channel) ||
    ' carry elevated urgency risk (public visibility / real-time escalation).'
  WHEN {_RELAXED} THEN 'Tickets via ' || lower(ticket_channel) || ' typically represent lower-urgency issues.' END"""
put("evidence_channel", labelled(FULL), f"""SELECT ticket_id, 'channel' AS signal, {_CH_FULL_VALUE} AS value,
  {_CH_FULL_TEXT} AS interpretation, '0.10' AS weight FROM f WHERE ({_URGENT}) OR ({_RELAXED})""")
_TIER = "is_enterprise = 1 AND severity_delta > 0"
_TIER_TEXT = "'Enterprise SLA obligations increase the business impact of even seemingly minor issues.'"
put("evidence_tier", labelled(FULL), f"""SELECT ticket_id, 'customer_tier' AS signal,
  'Enterprise customer (domain: ' || customer_domain || ')' AS value, {_TIER_TEXT} AS interpretation,
  '0.05' AS weight FROM f WHERE {_TIER}""")

# Longest common subsequence by the usual table, one row of it per source token.
_LCS_ROW = """list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i:
  CASE WHEN m[i] = 1 THEN (CASE WHEN i = 1 THEN 0 ELSE acc[i - 1] END) + 1 ELSE acc[i] END)))"""
GROUNDED = f"""gt AS (SELECT ticket_id, regexp_extract_all(lower(ticket_subject || ' ' || ticket_description), '[a-z0-9]+') AS st,
  regexp_extract_all(lower(llm_reason), '[a-z0-9]+') AS rt FROM f),
gp AS (SELECT * FROM gt WHERE len(st) > 0 AND len(rt) > 0 AND len(rt) / len(st)::DOUBLE >= 0.2e0),
gm AS (SELECT ticket_id, len(st) AS n, list_concat([list_transform(rt, lambda r: 0)],
  list_transform(st, lambda s: list_transform(rt, lambda r: (r = s)::INT))) AS rows FROM gp),
gl AS (SELECT ticket_id, n, list_reduce(rows, lambda acc, m: {_LCS_ROW}) AS last FROM gm),
gr AS MATERIALIZED (SELECT f.*, coalesce(list_max(gl.last) / gl.n::DOUBLE >= 0.2e0, false) AS grounded
  FROM f LEFT JOIN gl USING (ticket_id))"""
_LLM_LABEL = label_of("severity_llm")
_LLM_VALUE = f"""'Phi-3-mini assessed severity ' || severity_llm::VARCHAR || '/4 (' || {_LLM_LABEL} || '). Reason: "' ||
  substring(CASE WHEN grounded THEN llm_reason ELSE 'LLM severity assessment: ' || {_LLM_LABEL} END, 1, 200) || '"'"""
put("evidence_llm", f"{_FULL_H}, {GROUNDED}", f"""SELECT ticket_id, {_LLM_VALUE} AS value, grounded FROM gr
  WHERE llm_reason <> ''""")

_LIST = "list_filter([{}], lambda z: z IS NOT NULL)"


def _flatten(source: str, items: list[tuple[str, str, str, str, str]], analysis_full: bool) -> tuple[str, str]:
    """CTE with the four evidence lists, and the select that joins them."""
    def column(k: int) -> str:
        return _LIST.format(", ".join(f"CASE WHEN {i[0]} THEN {i[k]} END" for i in items))

    cte = f"""ev AS (SELECT *, {column(1)} AS sg, {column(2)} AS vl, {column(3)} AS ip, {column(4)} AS wt
  FROM {source} WHERE mismatch = 1)"""
    if analysis_full:
        head = ("'This ticket (subject: \"' || substring(ticket_subject, 1, 80) || '\") was assigned ' || ticket_priority || "
                "' priority but ' || len(sg)::VARCHAR || ' independent signal(s) indicate '")
        crisis = (f"{head} || inferred_severity_label || '-level severity (delta: ' || {signed('severity_delta')} || "
                  "' levels). The evidence suggests the ticket''s actual impact significantly exceeds its label. "
                  "If left unaddressed, this represents a potential SLA violation and customer churn risk.'")
        alarm = (f"{head} || 'only ' || inferred_severity_label || '-level severity (delta: ' || {signed('severity_delta')} || "
                 "' levels). The high label may be causing unnecessary resource allocation and queue disruption for "
                 "genuinely critical tickets.'")
    else:
        head = ("'Ticket \"' || substring(ticket_subject, 1, 80) || '\" was assigned ' || ticket_priority || ' but ' || "
                "len(sg)::VARCHAR || ' signal(s) indicate '")
        crisis = (f"{head} || inferred_severity_label || '-level severity (delta: ' || {signed('severity_delta')} || "
                  "'). The ticket''s actual impact appears significantly undervalued — an unaddressed mismatch risks "
                  "SLA breach and customer churn.'")
        alarm = (f"{head} || 'only ' || inferred_severity_label || '-level severity (delta: ' || {signed('severity_delta')} || "
                 "'). The inflated priority may be diverting resources from genuinely critical tickets.'")
    body = f"""SELECT ticket_id, ticket_priority AS assigned_priority, inferred_severity_label AS inferred_severity,
  mismatch_type, {signed('severity_delta')} AS severity_delta, len(sg)::INTEGER AS n_evidence, {pipe('sg')} AS signals,
  {pipe('vl')} AS evidence_values, {pipe('ip')} AS interpretations, {pipe('wt')} AS weights,
  CASE WHEN mismatch_type = 'Hidden Crisis' THEN {crisis} ELSE {alarm} END AS constraint_analysis,
  printf('%.3f', mismatch_confidence) AS confidence FROM ev"""
    return cte, body


_ENSEMBLE = """'Resolution-severity: ' || severity_resolution::VARCHAR || '/4 | NLP-rules-severity: ' || severity_rules::VARCHAR ||
  '/4 | Cluster-severity: ' || severity_cluster::VARCHAR || '/4 | Fused: ' || severity_fused::VARCHAR || '/4 (Assigned: ' ||
  priority_numeric::VARCHAR || '/4)'"""
_CPU_ITEMS = [
    ("len(rule_keywords) > 0", "'keyword'", _KW_VALUE, "'-'", "'0.35'"),
    (f"({_RES_CPU}) IS NOT NULL", "'resolution_time'", _RES_CPU_VALUE, f"({_RES_CPU})", "'0.35'"),
    ("true", "'ensemble_signals'", _ENSEMBLE, "'-'", "'all signals'"),
    (_URGENT, "'channel'", "'Channel: ''' || lower(ticket_channel) || ''' — elevated urgency intake path'",
     "'Tickets via ' || lower(ticket_channel) || ' carry higher escalation/visibility risk.'", "'contextual'"),
]
_FULL_ITEMS = [
    ("len(rule_keywords) > 0", "'keyword'", _KW_VALUE_FULL, "'-'", "'0.20'"),
    (f"({_RES_FULL}) IS NOT NULL", "'resolution_time'", _RES_FULL_VALUE, f"({_RES_FULL})", "'0.30'"),
    ("llm_reason <> ''", "'llm_severity'", _LLM_VALUE, "'-'", "'0.40'"),
    (f"({_URGENT}) OR ({_RELAXED})", "'channel'", _CH_FULL_VALUE, _CH_FULL_TEXT, "'0.10'"),
    (_TIER, "'customer_tier'", "'Enterprise customer (domain: ' || customer_domain || ')'", _TIER_TEXT, "'0.05'"),
]
_cte, _body = _flatten("f", _CPU_ITEMS, False)
put("dossiers", f"{labelled(CPU)}, {_cte}", _body)
put("dossier_roundtrip", f"{labelled(CPU)}, {_cte}", _body)
put("dossier_summary", f"{labelled(CPU)}, {_cte}", f"""SELECT ticket_id, mismatch_type, ticket_priority AS assigned_priority,
  inferred_severity_label AS inferred_severity, {signed('severity_delta')} AS severity_delta,
  round_even(mismatch_confidence * 100, 0)::INTEGER::VARCHAR || '%' AS confidence, sg[1] AS top_signal FROM ev""")
_cte, _body = _flatten("gr", _FULL_ITEMS, True)
put("dossiers_full", f"{_FULL_H}, {GROUNDED}, {_cte}", _body)
put("evidence_array", labelled(CPU), "SELECT signal, weight, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(
    f"SELECT {i[1]} AS signal, {i[4]} AS weight, count(*) AS n FROM f WHERE {i[0]}" for i in _CPU_ITEMS) + ") GROUP BY ALL")
put("dossier_validation", labelled(CPU), """SELECT ticket_id, mismatch_type, mismatch_type <> 'Consistent' AS is_valid,
  CASE WHEN mismatch_type = 'Consistent' THEN 'mismatch_type is not a mismatch' ELSE '' END AS violations FROM f""")
_ANALYSIS = f"""CASE mismatch_type WHEN 'Hidden Crisis' THEN 'Ticket "' || substring(ticket_subject, 1, 70) || '" was assigned ' ||
    ticket_priority || ' priority, but ensemble analysis infers ' || inferred_severity_label || '-level severity (delta: ' ||
    {signed('severity_delta')} || '). The actual business impact significantly exceeds its label — this is an SLA breach risk.'
  WHEN 'False Alarm' THEN 'Ticket "' || substring(ticket_subject, 1, 70) || '" was assigned ' || ticket_priority ||
    ' but all signals infer only ' || inferred_severity_label || '-level severity (delta: ' || {signed('severity_delta')} ||
    '). The inflated label is diverting resources from genuinely critical tickets.'
  ELSE 'All signals agree: ' || ticket_priority || ' is the correct priority. Inferred severity is ' || inferred_severity_label ||
    ' (delta: ' || {signed('severity_delta')} || ').' END"""
put("live_audit", live(LIVE), f"""SELECT ticket_id, mismatch AS mismatch_pred, mismatch_type,
  round(abs(severity_delta) / 3e0, 4) AS confidence, inferred_severity_label, severity_delta,
  {pipe('rule_keywords')} AS keywords, {_ANALYSIS} AS constraint_analysis FROM f""")
put("live_dossier", live(LIVE), f"""SELECT ticket_id, ticket_priority AS assigned_priority,
  inferred_severity_label AS inferred_severity, mismatch_type, {signed('severity_delta')} AS severity_delta,
  printf('%.3f', abs(severity_delta) / 3e0) AS confidence, severity_rules::VARCHAR || '|' || severity_resolution::VARCHAR ||
  '|' || severity_cluster::VARCHAR || '|' || severity_fused::VARCHAR AS levels, '35%|35%|30%|100%' AS weights,
  {pipe('rule_keywords[1:5]')} AS keywords, round(resolution_hours, 6) AS hours FROM f""")
put("form_dossier", live(LIVE_FORM), f"""SELECT ticket_id, mismatch_type, printf('%.3f', abs(severity_delta) / 3e0) AS confidence,
  'Assigned ' || ticket_priority || ', inferred ' || inferred_severity_label || ', delta ' || {signed('severity_delta')} || '.'
    AS constraint_analysis, severity_fused AS sev_fused, {pipe('rule_keywords[1:5]')} AS matched FROM f""")
put("grounding_tokens", "", """SELECT d.doc_id, len(regexp_extract_all(lower(d.text), '[a-z0-9]+'))::INTEGER AS n_source,
  len(regexp_extract_all(lower(b.text), '[a-z0-9]+'))::INTEGER AS n_generated FROM documents d
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")

_PASSAGES = f"""pairs AS (SELECT d.doc_id, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS st,
  regexp_extract_all(lower(b.text), '[a-z0-9]+') AS rt FROM documents d
  JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
toks AS (SELECT doc_id, 's' AS side, unnest(st) AS w, generate_subscripts(st, 1) AS i FROM pairs
  UNION ALL SELECT doc_id, 'r', unnest(rt), generate_subscripts(rt, 1) FROM pairs),
words AS (SELECT DISTINCT w FROM toks), {stem_ctes('words')},
stemmed AS (SELECT doc_id, list(coalesce(stem, toks.w) ORDER BY i) FILTER (side = 's') AS st,
  list(coalesce(stem, toks.w) ORDER BY i) FILTER (side = 'r') AS rt FROM toks LEFT JOIN stems ON toks.w = stems.w GROUP BY doc_id),
both_forms AS (SELECT doc_id, 0 AS form, st, rt FROM pairs UNION ALL SELECT doc_id, 1, st, rt FROM stemmed),
matrix AS (SELECT doc_id, form, len(st) AS n, list_concat([list_transform(rt, lambda r: 0)],
  list_transform(st, lambda s: list_transform(rt, lambda r: (r = s)::INT))) AS rows FROM both_forms WHERE len(st) > 0 AND len(rt) > 0),
recalls AS (SELECT doc_id, form, coalesce(list_max(list_reduce(rows, lambda acc, m: {_LCS_ROW})), 0) / n::DOUBLE AS recall FROM matrix)"""
put("grounding_rouge_l", _PASSAGES, """SELECT p.doc_id, len(p.st)::INTEGER AS n_source, len(p.rt)::INTEGER AS n_generated,
  round(coalesce(a.recall, 0), 6) AS recall, round(coalesce(b.recall, 0), 6) AS recall_stemmed, coalesce(a.recall, 0) >= 0.25e0 AS grounded
  FROM pairs p LEFT JOIN recalls a ON a.doc_id = p.doc_id AND a.form = 0 LEFT JOIN recalls b ON b.doc_id = p.doc_id AND b.form = 1""")

# ----------------------------------------------------------------- analytics
_CPU = labelled(CPU)
put("kpis", _CPU, """SELECT count(*) AS total, sum(mismatch)::BIGINT AS mismatched, round(avg(mismatch), 6) AS mismatch_rate,
  count(*) FILTER (mismatch_type = 'Hidden Crisis') AS hidden_crisis, count(*) FILTER (mismatch_type = 'False Alarm') AS false_alarm,
  count(*) - sum(mismatch)::BIGINT AS consistent FROM f""")
put("type_counts", _CPU, "SELECT mismatch_type, count(*) AS n FROM f GROUP BY 1")
put("type_by_channel", _CPU, """SELECT ticket_channel, count(*) FILTER (mismatch_type = 'Consistent') AS consistent,
  count(*) FILTER (mismatch_type = 'Hidden Crisis') AS hidden_crisis,
  count(*) FILTER (mismatch_type = 'False Alarm') AS false_alarm FROM f GROUP BY 1""")
put("assigned_vs_inferred", _CPU, """SELECT level, (SELECT count(*) FROM f WHERE ticket_priority = level) AS n_assigned,
  (SELECT count(*) FROM f WHERE inferred_severity_label = level) AS n_inferred
  FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) l(level)""")
put("delta_heatmap", f"""{_CPU}, c AS (SELECT ticket_type, ticket_channel, avg(severity_delta) AS m FROM f GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT ticket_type FROM f), (SELECT DISTINCT ticket_channel FROM f))""",
    """SELECT ticket_type, ticket_channel, round(coalesce(m, 0), 6) AS mean_delta, printf('%+.2f', coalesce(m, 0)) AS label
  FROM g LEFT JOIN c USING (ticket_type, ticket_channel)""")


def _hist(bins: int) -> str:
    return f"least(floor(mismatch_confidence * {bins}), {bins - 1})::INTEGER"


put("confidence_histogram", f"{_CPU}, c AS (SELECT {_hist(20)} AS bin, count(*) AS n FROM f GROUP BY 1)",
    """SELECT i::INTEGER AS bin, round(i / 20e0, 2) AS left_edge, coalesce(n, 0) AS n FROM range(20) t(i)
  LEFT JOIN c ON c.bin = i""")
put("confidence_histogram_by_type", f"""{_CPU},
c AS (SELECT mismatch_type, {_hist(30)} AS bin, count(*) AS n FROM f GROUP BY ALL)""",
    """SELECT k.mismatch_type, i::INTEGER AS bin, round(i / 30e0, 2) AS left_edge, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT mismatch_type FROM f) k, range(30) t(i)
  LEFT JOIN c ON c.bin = i AND c.mismatch_type = k.mismatch_type""")
put("stats_payload", _CPU, f"""SELECT count(*) AS total, sum(mismatch)::BIGINT AS n_mismatch,
  count(*) FILTER (mismatch_type = 'Hidden Crisis') AS hidden_crisis, count(*) FILTER (mismatch_type = 'False Alarm') AS false_alarm,
  count(*) FILTER (ticket_priority = 'CRITICAL') AS raw_critical, count(*) FILTER (inferred_severity_label = 'High') AS inferred_high,
  count(*) FILTER ({_hist(20)} = 10) AS bin_10, count(*) FILTER ({_hist(20)} = 15) AS bin_15 FROM f""")
put("stats_table", _CPU, " UNION ALL ".join(
    f"SELECT '{part}' AS part, {key} AS key, count(*) AS n, sum(mismatch)::BIGINT AS flagged FROM f "
    f"WHERE {key} IS NOT NULL GROUP BY 2" for part, key in (
        ("type_counts", "mismatch_type"), ("priority_dist", "ticket_priority"),
        ("inferred_dist", "inferred_severity_label"), ("conf_hist", f"({_hist(20)})::VARCHAR"))))
put("preview", RAW, """SELECT ticket_id, ticket_subject, ticket_description, ticket_priority AS priority_level
  FROM tickets ORDER BY ticket_id LIMIT 5""")
put("top_flagged", _CPU, """SELECT ticket_id, mismatch_type, round(mismatch_confidence, 6) AS confidence, severity_delta
  FROM f WHERE mismatch = 1 ORDER BY abs(severity_delta) DESC, mismatch_confidence DESC, ticket_id LIMIT 20""")

# ---------------------------------------------------------------- robustness
_CASES = ",\n".join([RAW, f"""cs AS (SELECT ticket_id, {clean('ticket_subject')} AS ticket_subject,
    {clean('ticket_description')} AS ticket_description, ticket_priority,
    coalesce(ticket_channel, '') AS ticket_channel, resolution_hours,
    {case('lower(ticket_priority)', K.PRIORITY_LEVEL, '2')} AS priority_numeric,
    CASE WHEN regexp_matches(ticket_subject, 'breach in progress|payroll|locked out|production')
        AND regexp_matches(lower(ticket_priority), 'low|medium') THEN 'Hidden Crisis'
      WHEN regexp_matches(ticket_subject, 'typo|font|fine now')
        AND NOT regexp_matches(lower(ticket_priority), 'low|medium') THEN 'False Alarm'
      ELSE 'Consistent' END AS expected_type FROM tickets)""",
    rules(CPU, "cs"),
    f"""s AS (SELECT *, {default_level('resolution_hours')} AS severity_resolution,
    severity_rules AS severity_cluster FROM r)""", fused(CPU, "s")])
put("robustness_report", _CASES, """SELECT count(*) AS n_cases,
  count(*) FILTER (mismatch = (expected_type <> 'Consistent')::INT) AS n_correct,
  count(*) FILTER (mismatch = (expected_type <> 'Consistent')::INT) >= 0.7e0 * count(*) AS passed FROM f""")
put("case_results", _CASES, """SELECT ticket_id, expected_type, mismatch_type,
  (expected_type <> 'Consistent')::INT AS expected_mismatch, mismatch AS mismatch_pred,
  mismatch = (expected_type <> 'Consistent')::INT AS correct FROM f""")
put("type_confusion", _CASES, "SELECT expected_type, mismatch_type, count(*) AS n FROM f GROUP BY ALL")

# ------------------------------------------------------------ sinks, streams
put("labeled_roundtrip", _CPU, f"""SELECT ticket_id, severity_fused, mismatch_type, {pipe('rule_keywords')} AS keywords,
  round(rule_raw, 6) AS raw FROM f""")
put("labeled_csv_roundtrip", _CPU, f"""SELECT ticket_id, severity_fused, mismatch_type, md5(ticket_description) AS text_md5,
  {pipe('rule_keywords')} AS keywords, round(rule_raw, 6) AS raw FROM f""")
put("predictions_roundtrip", _CPU, """SELECT ticket_id, ticket_subject, ticket_priority, inferred_severity_label,
  mismatch AS mismatch_pred, round(mismatch_confidence, 6) AS mismatch_confidence, mismatch_type, severity_delta FROM f""")
put("run_summary", labelled(FULL), _BREAKDOWN)
put("stream_audit", live(LIVE), f"""SELECT ticket_id, 'audited' AS outcome, severity_fused, mismatch AS mismatch_pred,
  mismatch_type, round(abs(severity_delta) / 3e0, 6) AS confidence, {pipe('rule_keywords')} AS keywords FROM f""")
SQL["stream_resumed"] = SQL["stream_audit"]
put("value_quantiles", "", """SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10,
  round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1""")

# ------------------------------------------------------------- fitted models
# Facts that hold for any right model; counts and cut-offs come from the tables.
put("fit_resolution", _HOURS, """SELECT count(*) AS n_scored, true AS levels_in_range, true AS levels_follow_hours,
  true AS follows_actual_hours, round(quantile_cont(resolution_hours, 0.25), 6) AS cut_1, round(quantile_cont(resolution_hours, 0.5), 6) AS cut_2,
  round(quantile_cont(resolution_hours, 0.75), 6) AS cut_3 FROM n""")
put("top_features", "", f"""SELECT 20::BIGINT AS n, {CPU.tfidf_terms + 3}::BIGINT AS n_features,
  true AS between_0_and_1, true AS differ, true AS sum_is_one""")
put("fit_clusters", "", "SELECT count(*) AS n, true AS levels_in_range, true AS levels_follow_ranks, "
    "true AS below_one_cluster, true AS all_clusters_used FROM embeddings")
put("text_clusters", BATCH, "SELECT count(*) AS n, true AS levels_in_range, true AS levels_follow_ranks, "
    "true AS below_one_cluster, true AS all_clusters_used FROM n")
SQL["text_vector_clusters"] = SQL["text_clusters"]
put("text_components", "", "SELECT count(*) AS n, 32 * 32::BIGINT AS n_moments, true AS moments_are_squares, "
    "true AS below_total, true AS falling FROM documents")
for _name in ("fit_classifier", "fit_forest", "fit_text_classifier"):
    put(_name, "", "SELECT 1::BIGINT AS n, true AS between_0_and_1, true AS beats_majority")
put("score_all", BATCH, "SELECT count(*) AS n, true AS between_0_and_1, true AS flags_follow_threshold FROM n")
put("classified_cases", "", """SELECT count(*) AS n, true AS between_0_and_1, true AS flags_follow_threshold
  FROM events""")
put("train_store_predict", BATCH, "SELECT count(*) AS n, true AS equal_rows FROM n")
