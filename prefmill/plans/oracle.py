"""SQL statements of the registered queries, for an independent engine (DuckDB).

They state what a query means over the whole tables: windows over everything, lists,
and the verifiers' predicates in SQL. Nothing here is used by the Spark side.
"""

from __future__ import annotations

from prefmill.functions import chat
from prefmill.functions.tokens import HASHED_VOCABULARY, TOKEN_PATTERN
from prefmill.plans import fixtures
from prefmill.functions.permute import ROUNDS
from prefmill.plans.catalog import BATCH_SIZE, EPOCHS, GENERATED, SAMPLES
from prefmill.plans.fixtures import TEMPLATES
from prefmill.sources.jsonl import COUNTERS

STYLE = chat.ChatStyle()


def lit(text: str) -> str:
    """A SQL string, with control characters spelled out."""
    quoted = text.replace("'", "''").replace("\n", "' || chr(10) || '").replace(
        "\r", "' || chr(13) || '"
    )
    return f"('{quoted}')"


def h(*parts: str) -> str:
    """The md5 integer of SQL expressions joined by colons."""
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def fill(template: str, **slots: str) -> str:
    """A template as a SQL concat; slots are SQL expressions."""
    marks = {name: f"\x00{name}\x00" for name in slots}
    for name, mark in marks.items():
        template = template.replace("{%s}" % name, mark)
    out = []
    for piece in template.split("\x00"):
        if piece in slots and f"\x00{piece}\x00" in marks.values():
            out.append(slots[piece])
        elif piece:
            out.append(lit(piece))
    return "(" + " || ".join(out) + ")"


def turn(role: str, content: str) -> str:
    opening = f"{STYLE.role_open}{role}{STYLE.role_close}"
    return f"{lit(opening)} || {content} || {lit(STYLE.turn_end)}"


def rendered(*turns: str, reply: bool = False) -> str:
    parts = [lit(STYLE.begin), *turns]
    if reply:
        parts.append(lit(f"{STYLE.role_open}assistant{STYLE.role_close}"))
    return "(" + " || ".join(parts) + ")"


def by_template(values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE template {whens} END"


def code(x: str) -> str:
    """Verdict code of (template, verifier_pos) over the text x."""
    whens = []
    for t, template in enumerate(TEMPLATES):
        for v, verifier in enumerate(template.verifiers):
            if verifier.code is not None:
                whens.append(f"WHEN {t * 10 + v} THEN ({verifier.code})")
    return f"(SELECT CASE template * 10 + verifier_pos {' '.join(whens)} END FROM (SELECT {x} AS x))"


COMPILED = "(template * 10 + verifier_pos) IN ({})".format(
    ", ".join(
        str(t * 10 + v)
        for t, template in enumerate(TEMPLATES)
        for v, verifier in enumerate(template.verifiers)
        if verifier.code is not None
    )
)

CTES: dict[str, str] = {}

CTES["opener"] = """
  SELECT conv_id, coalesce(arg_min(text, turn), '') AS query FROM conversations GROUP BY conv_id"""

CTES["first_messages"] = """
  SELECT conv_id, query FROM opener WHERE length(query) BETWEEN 5 AND 200"""

CTES["sampled"] = f"""
  SELECT d.instance_id, q.conv_id, q.query
  FROM (SELECT doc_id AS instance_id,
               {h("42", "doc_id")} % (SELECT count(*) FROM first_messages) AS idx FROM documents) d
  JOIN (SELECT *, row_number() OVER (ORDER BY {h("42", "conv_id")}, conv_id) - 1 AS idx
        FROM first_messages) q ON q.idx = d.idx"""

CTES["instances"] = f"""
  SELECT instance_id, query, template, {by_template([lit(t.instruction) for t in TEMPLATES])} AS instruction
  FROM (SELECT conv_id AS instance_id, query, (conv_id % {len(TEMPLATES)})::INT AS template FROM opener)"""

CTES["verifiers"] = """
  SELECT * FROM (VALUES {}) AS v(template, verifier_pos, source)""".format(
    ", ".join(
        f"({t}, {v}, {lit(verifier.source)})"
        for t, template in enumerate(TEMPLATES)
        for v, verifier in enumerate(template.verifiers)
    )
)

CTES["instance_verifiers"] = f"""
  SELECT instance_id, template, verifier_pos, source, {COMPILED} AS compiled
  FROM instances JOIN verifiers USING (template)"""


def _own(result: str) -> str:
    return f"to_json({{'response': query, 'result': {result}}})"


def _blocks() -> str:
    good = by_template([lit(fixtures.case_line(t.good, True)) for t in TEMPLATES])
    bad = by_template([lit(fixtures.case_line(t.bad, False)) for t in TEMPLATES])
    odd = lit('{"response": 7, "result": true}\n{"response": "x", "result": 1}\n\n')
    bad_blocks = ", ".join(lit(b) for b in fixtures.BAD_BLOCKS)
    return f"""
  SELECT instance_id, unnest(blocks) AS block, generate_subscripts(blocks, 1) AS block_pos
  FROM (SELECT instance_id, CASE WHEN instance_id % 10 = 7 THEN [{bad_blocks}] ELSE [
          {good} || chr(10) || {bad},
          {_own("true")} || chr(13) || chr(10) || 'this line is no JSON',
          {odd} || {good},
          {_own("false")} || chr(8232) || '["response", "result"]'] END AS blocks
        FROM instances)"""


CTES["blocks"] = _blocks()

CTES["cases"] = r"""
  SELECT instance_id, line->>'$.response' AS response, (line->>'$.result')::BOOLEAN AS result,
         row_number() OVER (PARTITION BY instance_id ORDER BY block_pos, line_pos) - 1 AS case_pos
  FROM (SELECT instance_id, block_pos, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_pos
        FROM (SELECT *, regexp_split_to_array(block,
                '\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS lines FROM blocks))
  WHERE CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT'
             AND json_type(line, '$.response') = 'VARCHAR' AND json_type(line, '$.result') = 'BOOLEAN'
             ELSE false END"""

CTES["verdicts"] = f"""
  SELECT v.instance_id, v.template, v.verifier_pos, v.source, v.compiled, c.case_pos, c.response, c.result,
         {code("c.response")} AS code
  FROM instance_verifiers v
  LEFT JOIN cases c ON c.instance_id = v.instance_id AND v.compiled"""

CTES["passes"] = """
  SELECT instance_id, verifier_pos, source, case_pos, response, result,
         (code & CASE WHEN result THEN 1 ELSE 2 END) <> 0 AS pass
  FROM verdicts WHERE compiled AND case_pos IS NOT NULL"""

CTES["kept_cases"] = """
  SELECT instance_id, case_pos, any_value(response) AS response, any_value(result) AS result
  FROM passes GROUP BY instance_id, case_pos HAVING bool_or(pass)"""

CTES["rated"] = """
  SELECT instance_id, verifier_pos, any_value(source) AS source, sum(pass::INT) AS passed, count(*) AS cases
  FROM passes SEMI JOIN kept_cases USING (instance_id, case_pos) GROUP BY instance_id, verifier_pos"""

CTES["kept_verifiers"] = """
  SELECT * FROM rated WHERE passed * 5 >= cases * 4"""

CTES["counters"] = """
  SELECT instance_id, 4 AS verifier_count, 4 AS testcase_str_count, compiled_verifiers,
         CASE WHEN compiled_verifiers > 0 THEN n_cases ELSE 0 END AS test_cases_parse,
         n_kept AS test_cases_pass_gte1, n_good AS verifiers_pass_80pct,
         total_passes, (n_good > 0)::INT AS unique_instances
  FROM (SELECT instance_id,
          (SELECT count(*) FROM instance_verifiers v WHERE v.instance_id = i.instance_id AND compiled) AS compiled_verifiers,
          (SELECT count(*) FROM cases c WHERE c.instance_id = i.instance_id) AS n_cases,
          (SELECT count(*) FROM kept_cases k WHERE k.instance_id = i.instance_id) AS n_kept,
          (SELECT count(*) FROM kept_verifiers k WHERE k.instance_id = i.instance_id) AS n_good,
          (SELECT coalesce(sum(passed), 0) FROM rated r WHERE r.instance_id = i.instance_id) AS total_passes
        FROM instances i)"""

CTES["completions"] = f"""
  SELECT idx // {fixtures.NUM_COMPLETIONS} AS instance_id, idx % {fixtures.NUM_COMPLETIONS} AS slot, text AS completion
  FROM (SELECT text, row_number() OVER (ORDER BY {h("'docs'", "doc_id")}, doc_id) - 1 AS idx FROM documents)"""

CTES["slots"] = f"""
  SELECT * FROM completions UNION ALL
  SELECT instance_id, (SELECT max(slot) + 1 FROM completions c WHERE c.instance_id = f.instance_id) AS slot, completion
  FROM completions f WHERE slot = 0 AND instance_id % 5 = 0"""

CTES["completed"] = f"""
  SELECT a.instance_id, conv_id, i.query, i.instruction, i.template
  FROM (SELECT DISTINCT instance_id FROM completions) a
  JOIN (SELECT conv_id, row_number() OVER (ORDER BY {h("'convs'", "conv_id")}, conv_id) - 1 AS conv_idx
        FROM (SELECT DISTINCT conv_id FROM conversations)) c
    ON conv_idx = a.instance_id % (SELECT count(DISTINCT conv_id) FROM conversations)
  JOIN instances i ON i.instance_id = c.conv_id"""

CTES["completion_codes"] = f"""
  SELECT c.instance_id, conv_id, verifier_pos, {COMPILED} AS compiled, slot, completion,
         {code("completion")} AS code
  FROM completed c JOIN verifiers USING (template) JOIN slots s ON s.instance_id = c.instance_id"""

CTES["rates"] = """
  SELECT instance_id, slot, any_value(completion) AS completion,
         sum(CASE WHEN compiled AND (code & 4) <> 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE AS rate
  FROM completion_codes GROUP BY instance_id, slot"""

CTES["kept_rates"] = """
  SELECT instance_id, slot, any_value(completion) AS completion,
         sum(CASE WHEN (code & 4) <> 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS rate
  FROM completion_codes c SEMI JOIN kept_verifiers k
    ON k.instance_id = c.conv_id AND k.verifier_pos = c.verifier_pos
  GROUP BY c.instance_id, slot"""


def _score_map(rates: str) -> str:
    return f"""
  SELECT instance_id, completion, min(slot) AS first_slot, arg_max(rate, slot) AS score
  FROM {rates} GROUP BY instance_id, completion"""


def _pairs(scores: str, limit: str = "greatest(nc, nr)") -> str:
    return f"""
  SELECT instance_id, i::INT AS pair_idx, query || chr(10) || instruction AS prompt,
         c[(i % nc) + 1] AS chosen, r[(i % nr) + 1] AS rejected
  FROM (SELECT *, len(c) AS nc, len(r) AS nr, unnest(range(CASE WHEN least(len(c), len(r)) > 0
                 THEN {limit.replace('nc', 'len(c)').replace('nr', 'len(r)')} ELSE 0 END)) AS i
        FROM (SELECT instance_id,
                coalesce(list(completion ORDER BY first_slot) FILTER (score >= 0.5), []) AS c,
                coalesce(list(completion ORDER BY first_slot) FILTER (score = 0), []) AS r
              FROM {scores} GROUP BY instance_id))
  JOIN completed USING (instance_id)"""


CTES["score_map"] = _score_map("rates")
CTES["kept_score_map"] = _score_map("kept_rates")
CTES["pairs"] = _pairs("score_map")
CTES["kept_pairs"] = _pairs("kept_score_map")


def _crc_entry(value: int) -> int:
    for _ in range(8):
        value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
    return value


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, spelled out over a table made by its rule."""
    entries = ", ".join(f"{_crc_entry(i)}" for i in range(256))
    code = f"hex(encode({text}))"
    byte = f"('0x' || substr({code}, 2 * i + 1, 2))::BIGINT"
    return (
        f"xor(list_reduce(list_transform(range(length({code}) // 2), lambda i: {byte}), "
        f"lambda crc, b: xor(crc >> 8, ([{entries}]::BIGINT[])[(xor(crc, b) & 255) + 1]), "
        "4294967295::BIGINT), 4294967295)"
    )


def _tokens(text: str, view: str) -> str:
    return f"""SELECT instance_id, pair_idx, '{view}' AS view,
         regexp_extract_all({text}, '{TOKEN_PATTERN}') AS tokens FROM pairs"""


_VIEW_TEXTS = {
    "chosen": rendered(turn("user", "prompt"), turn("assistant", "chosen")),
    "rejected": rendered(turn("user", "prompt"), turn("assistant", "rejected")),
    "context": rendered(turn("user", "prompt"), reply=True),
}
CTES["view_tokens"] = "\n  UNION ALL ".join(_tokens(text, view) for view, text in _VIEW_TEXTS.items())

CTES["view_rows"] = """
  SELECT instance_id, pair_idx, view, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos
  FROM view_tokens"""

CTES["vocabulary"] = f"""
  SELECT token, {_crc32("token")} % {HASHED_VOCABULARY} AS id FROM (SELECT DISTINCT token FROM view_rows)"""

CTES["views"] = """
  SELECT instance_id, pair_idx, list(id ORDER BY pos) FILTER (view = 'chosen') AS chosen,
         list(id ORDER BY pos) FILTER (view = 'rejected') AS rejected,
         list(id ORDER BY pos) FILTER (view = 'context') AS context
  FROM view_rows JOIN vocabulary USING (token) GROUP BY instance_id, pair_idx"""

CTES["batched"] = f"""
  SELECT *, idx // {BATCH_SIZE} AS batch_id, (idx % {BATCH_SIZE})::INT AS batch_pos
  FROM (SELECT *, row_number() OVER (ORDER BY {h("'42:0'", "key")}, key) - 1 AS idx
        FROM (SELECT *, '{{"instance_id":' || instance_id || ',"pair_idx":' || pair_idx || '}}' AS key FROM views))"""

CTES["epochs"] = f"""
  SELECT instance_id, pair_idx, epoch, n, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b,
         row_number() OVER (PARTITION BY epoch ORDER BY {h("'42'", "key")}, key) - 1 AS x
  FROM (SELECT *, '{{"instance_id":' || instance_id || ',"pair_idx":' || pair_idx || '}}' AS key,
               (SELECT count(*) FROM pairs) AS n FROM pairs), range({EPOCHS}) e(epoch)"""


def _network(source: str) -> str:
    """One application of the network to x, a sub-select for each round."""
    kept = "instance_id, pair_idx, epoch, n, a, b"
    inner = f"SELECT {kept}, x % a AS l, x // a AS r FROM {source}"
    for i in range(ROUNDS):
        added = h("42", "epoch", f"{i}", "r" if i % 2 == 0 else "l")
        halves = f"(l + {added} % a) % a AS l, r" if i % 2 == 0 else f"l, (r + {added} % b) % b AS r"
        inner = f"SELECT {kept}, {halves} FROM ({inner})"
    return f"SELECT {kept}, r * a + l AS x FROM ({inner})"


CTES["walk"] = f"{_network('epochs')} UNION ALL {_network('walk WHERE x >= n')}"

CTES["longest"] = """
  SELECT *, max(len(chosen)) OVER b AS max_chosen, max(len(rejected)) OVER b AS max_rejected,
         max(len(context)) OVER b AS max_context
  FROM batched WINDOW b AS (PARTITION BY batch_id)"""


def _stretch(name: str, side: str, at: int) -> str:
    part = f"list_slice(embedding::DOUBLE[], ({at} + 1) * q + 1 - least(len_{side}, q), ({at} + 1) * q)"
    return f"CASE WHEN len_{side} = 0 THEN 0 ELSE list_sum({part}) END AS {name}_{side}"


CTES["sums"] = f"""
  SELECT vec_id // {BATCH_SIZE} AS batch_id, len_chosen, len_rejected,
         {_stretch("pi", "chosen", 0)}, {_stretch("pi", "rejected", 1)},
         {_stretch("ref", "chosen", 2)}, {_stretch("ref", "rejected", 3)}
  FROM (SELECT *, len(embedding) // 4 AS q, vec_id % (q + 2) AS len_chosen, (vec_id * 7) % (q + 2) AS len_rejected
        FROM embeddings)"""


def _metrics(beta: float) -> str:
    x = f"({beta}::DOUBLE * ((pi_chosen - pi_rejected) - (ref_chosen - ref_rejected)))"
    return f"""
  SELECT batch_id, -avg(least({x}, 0) - ln(1 + exp(-abs({x})))) AS dpo_loss,
         avg(pi_chosen - pi_rejected) AS pi_margin, avg(ref_chosen - ref_rejected) AS ref_margin,
         avg((((pi_chosen - ref_chosen) - (pi_rejected - ref_rejected)) > 0)::INT) AS dpo_accuracy,
         -sum(pi_chosen) / sum(len_chosen) AS nll
  FROM sums GROUP BY batch_id"""


CTES["metrics"] = _metrics(0.1)
CTES["metrics_1"] = _metrics(1.0)

_TURN = (
    f"{lit(STYLE.begin)} || {lit(STYLE.role_open)} || role || {lit(STYLE.role_close)}"
    f" || text || {lit(STYLE.turn_end)}"
)
CTES["shift"] = f"""
  SELECT conv_id, turn, pos, token,
         CASE WHEN pos < 5 THEN 0.0::DOUBLE ELSE greatest(-1, least(1,
            -((conv_id * 31 + turn * 17 + (pos - 1) * 7919) % 3000) / 1000::DOUBLE
            + ((conv_id * 31 + turn * 17 + (pos - 1) * 104729) % 3000) / 1000::DOUBLE)) END AS score
  FROM (SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos
        FROM (SELECT conv_id, turn, regexp_extract_all({_TURN}, '{TOKEN_PATTERN}') AS t FROM conversations))"""


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _md5(items: str) -> str:
    return f"md5(array_to_string({items}, ','))"


def _view_columns(make) -> str:
    return ", ".join(make(v) for v in ("chosen", "rejected", "context"))


def _pad(view: str, value: str) -> str:
    pad = f"list_transform(range(max_{view} - len({view})), lambda i: 0)"
    return f"list_concat({pad}, {value})"


_PAD_IDS = _view_columns(lambda v: f"{_md5(_pad(v, v))} AS ids_md5_{v}")
_PAD_MASKS = _view_columns(
    lambda v: f"max_{v} - len({v}) + 1 AS starts_{v}, len({v})::INT AS len_{v}"
)

_STOP_CUT = (
    "split_part(split_part(split_part(text, chr(10), 1), '. ', 1), ',', 1)"
)
_STRIPPED = r"regexp_replace(piece, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '', 'g')"

_CHOICES = f"""
  SELECT doc_id // 4 AS item_id, doc_id % 4 AS option, text,
         -({h("'ll'", "doc_id")} % 100000) / 100::DOUBLE AS ll,
         {h("'gold'", "doc_id // 4")} % 4 AS gold FROM documents"""

_CHOICE_CARD = """
  SELECT round(avg((best = gold)::INT), 6) + 0.0 AS acc, round(avg((best_norm = gold)::INT), 6) + 0.0 AS acc_norm
  FROM (SELECT item_id, any_value(gold) AS gold,
          list(option ORDER BY ll DESC, option)[1] AS best,
          list(option ORDER BY ll / length(text) DESC, option)[1] AS best_norm
        FROM ({}) GROUP BY item_id)"""

def _generated() -> str:
    """The three generating stages, each prompt and the number drawn from it spelled out."""

    def answer(seed: str, slot: str, prompt: str) -> str:
        return f"'Use at least ' || ({h(seed, 'instance_id', slot, prompt)} % 90 + 10) || ' words.'"

    seeds = turn("user", lit(chat.INSTRUCTION_TEMPLATE.replace("{seeds}", fixtures.SEEDS)))
    ask = "{} || {} || query || {}".format(rendered(seeds, reply=True), lit("\nQuery: "), lit("\nInstruction:"))
    verify = turn("user", fill(chat.VERIFIER_TEMPLATE, query="query", instruction="instruction"))
    verifier_prompt = f"{rendered(verify, reply=True)} || {lit(chat.CODE_FENCE + chat.VERIFIER_OPENING)}"
    quoted = turn("assistant", f"{lit('```' + chr(10))} || verifier || '```'")
    cases = turn("user", fill(chat.TEST_CASE_TEMPLATE, instruction="instruction"))
    case_prompt = f"{rendered(verify, quoted, cases, reply=True)} || {lit(chat.TEST_CASE_OPENING)}"
    complete = turn(
        "user", fill(chat.COMPLETION_TEMPLATE, query="query", instruction="instruction", verifier="picked")
    )
    completion_prompt = rendered(complete, reply=True)
    return f"""
WITH opener AS ({CTES["opener"]}), first_messages AS ({CTES["first_messages"]}),
drawn AS (
  SELECT d.instance_id, q.query
  FROM (SELECT conv_id AS instance_id, {h("42", "conv_id")} % (SELECT count(*) FROM first_messages) AS idx
        FROM (SELECT DISTINCT conv_id FROM conversations)) d
  JOIN (SELECT *, row_number() OVER (ORDER BY {h("42", "conv_id")}, conv_id) - 1 AS idx FROM first_messages) q
    ON q.idx = d.idx),
instructed AS (SELECT *, {answer("42", "0", ask)} AS instruction FROM drawn),
verified AS (
  SELECT *, {lit(chat.VERIFIER_OPENING)} || {answer("42", "slot", verifier_prompt)} AS verifier
  FROM instructed, range({GENERATED}) r(slot)),
tested AS (
  SELECT *, {lit(chat.TEST_CASE_OPENING)} || {answer("43", "slot", case_prompt)} AS testcase FROM verified),
folded AS (
  SELECT instance_id, any_value(query) AS query, any_value(instruction) AS instruction,
         list(verifier ORDER BY slot) AS verifiers, list(testcase ORDER BY slot) AS testcases
  FROM tested GROUP BY instance_id),
completed AS (
  SELECT *, {answer("42", "slot", completion_prompt)} AS completion
  FROM (SELECT *, verifiers[{h("42", "instance_id", "slot")} % {GENERATED} + 1] AS picked
        FROM folded, range({GENERATED}) r(slot)))
SELECT instance_id, any_value(instruction) AS instruction,
       md5(array_to_string(any_value(verifiers), '|')) AS verifiers_md5,
       md5(array_to_string(any_value(testcases), '|')) AS testcases_md5,
       string_agg(completion, '|' ORDER BY slot) AS completions
FROM completed GROUP BY instance_id"""


# query name -> (the CTEs it needs, in order; the final SELECT)
_CASE_CTES = "opener instances verifiers instance_verifiers blocks cases"
_KEPT_CTES = f"{_CASE_CTES} verdicts passes kept_cases rated kept_verifiers"
_COMPLETED_CTES = "completions slots completed completion_codes"
_RATE_CTES = f"opener instances verifiers instance_verifiers {_COMPLETED_CTES} rates"
_PAIR_CTES = f"{_RATE_CTES} score_map pairs"
_COUNTER_LIST = ", ".join(COUNTERS)

_STATEMENTS: dict[str, tuple[str, str]] = {
    "hh_queries": (
        "",
        r"""
SELECT conv_id, query FROM (
  SELECT conv_id, regexp_split_to_array(string_agg(
      CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: '
                ELSE chr(10) || chr(10) || 'Assistant: ' END || text, '' ORDER BY turn),
      '\n\nHuman: |\n\nAssistant: ')[2] AS query
  FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
WHERE length(query) BETWEEN 5 AND 200""",
    ),
    "first_message_queries": ("opener first_messages", "SELECT conv_id, query FROM first_messages"),
    "message_list_queries": (
        "opener first_messages",
        """SELECT conv_id, query FROM first_messages
WHERE conv_id % 11 > 0 AND conv_id % 13 > 0 AND conv_id % 17 > 0""",
    ),
    "sampled_queries": (
        "opener first_messages sampled", "SELECT instance_id, conv_id, query FROM sampled",
    ),
    "merged_shards": ("", "SELECT conv_id, turn, role, text FROM conversations"),
    "clean_instructions": (
        "",
        f"""
SELECT page_id, count(*) AS pieces, sum(length(x))::BIGINT AS chars, min(x) AS least, max(x) AS greatest,
       sum({h("x")} % {1 << 40})::BIGINT AS checksum
FROM (SELECT page_id, {_STRIPPED} AS x
      FROM (SELECT page_id, unnest(regexp_split_to_array(html, '[<>]')) AS piece FROM pages))
WHERE x <> '' GROUP BY page_id""",
    ),
    "instruction_prompts": (
        "opener first_messages sampled",
        "SELECT instance_id, {} || {} || query || {} AS prompt FROM sampled".format(
            rendered(
                turn("user", lit(chat.INSTRUCTION_TEMPLATE.replace("{seeds}", fixtures.SEEDS + "\n"))),
                reply=True,
            ),
            lit("\nQuery: "), lit("\nInstruction:"),
        ),
    ),
    "verifier_prompts": (
        "opener instances",
        "SELECT instance_id, {} || {} AS prompt FROM instances".format(
            rendered(
                turn("user", fill(chat.VERIFIER_TEMPLATE, query="query", instruction="instruction")),
                reply=True,
            ),
            lit(chat.CODE_FENCE + chat.VERIFIER_OPENING),
        ),
    ),
    "testcase_prompts": (
        "opener instances verifiers",
        "SELECT instance_id, verifier_pos, {} || {} AS prompt FROM instances JOIN verifiers USING (template)".format(
            rendered(
                turn("user", fill(chat.VERIFIER_TEMPLATE, query="query", instruction="instruction")),
                turn("assistant", f"{lit('```' + chr(10))} || source || '```'"),
                turn("user", fill(chat.TEST_CASE_TEMPLATE, instruction="instruction")),
                reply=True,
            ),
            lit(chat.TEST_CASE_OPENING),
        ),
    ),
    "completion_prompts": (
        "opener instances verifiers",
        """
SELECT instance_id, slot::INT AS slot, {} AS prompt
FROM instances, range({}) r(slot) JOIN verifiers v
  ON v.template = instances.template AND v.verifier_pos = {} % 4""".format(
            rendered(
                turn(
                    "user",
                    fill(chat.COMPLETION_TEMPLATE, query="query", instruction="instruction",
                         verifier="source"),
                ),
                reply=True,
            ),
            fixtures.NUM_COMPLETIONS, h("42", "instance_id", "slot"),
        ),
    ),
    "generated_texts": (
        "opener instances",
        """
SELECT instance_id, sample_idx::INT AS sample_idx,
       'Use at least ' || ({} % 90 + 10) || ' words.' AS text
FROM (SELECT instance_id, {} || {} AS prompt FROM instances), range({}) r(sample_idx)""".format(
            h("42", "instance_id", "sample_idx", "prompt"),
            rendered(
                turn("user", fill(chat.VERIFIER_TEMPLATE, query="query", instruction="instruction")),
                reply=True,
            ),
            lit(chat.CODE_FENCE + chat.VERIFIER_OPENING), SAMPLES,
        ),
    ),
    "retried_generations": (
        "opener instances verifiers",
        """
SELECT instance_id, CASE WHEN instance_id % 3 = 0 THEN 2 ELSE 0 END::INT AS retries, sample_idx::INT AS sample_idx,
       'Use at least ' || ({} % 90 + 10) || ' words.' AS text
FROM (SELECT instance_id, sample_idx, CASE sample_idx WHEN 1 THEN {} ELSE {} || {} END AS prompt
      FROM instances JOIN verifiers USING (template), range(3) r(sample_idx) WHERE verifier_pos = 0)""".format(
            h("42", "instance_id", "sample_idx", "prompt"),
            rendered(
                turn(
                    "user",
                    fill(chat.COMPLETION_TEMPLATE, query="query", instruction="instruction", verifier="source"),
                ),
                reply=True,
            ),
            rendered(
                turn("user", fill(chat.VERIFIER_TEMPLATE, query="query", instruction="instruction")),
                reply=True,
            ),
            lit(chat.CODE_FENCE + chat.VERIFIER_OPENING),
        ),
    ),
    "replayed_generations": (
        "",
        """
SELECT prompt_id, array_to_string(list(CASE WHEN lost THEN '<missing>' ELSE {cut} END ORDER BY sample_idx), '|') AS texts
FROM (SELECT conv_id || ':' || turn AS prompt_id, sample_idx, {lost} % 7 = 0 AS lost,
             {idx} % (SELECT count(*) FROM benchmark) AS idx
      FROM (SELECT conv_id, turn, md5({prompt}) AS key FROM conversations), range({n}) r(sample_idx))
JOIN (SELECT text, row_number() OVER (ORDER BY {order}, item_id) - 1 AS idx FROM benchmark) USING (idx)
GROUP BY prompt_id""".format(
            cut=_STOP_CUT, idx=h("'replay'", "key", "sample_idx"), lost=h("'lost'", "key", "sample_idx"),
            prompt=rendered(turn("user", "text"), reply=True), n=SAMPLES,
            order=h("'replay'", "item_id"),
        ),
    ),
    "generated_dataset": ("", _generated()),
    "parsed_test_cases": (
        "opener instances blocks cases",
        "SELECT instance_id, case_pos::INT AS case_pos, response, result FROM cases",
    ),
    "verdict_matrix": (
        f"{_CASE_CTES} verdicts",
        """
SELECT instance_id, verifier_pos, compiled, case_pos::INT AS input_pos, (code & 1) <> 0 AS eq_true,
       (code & 2) <> 0 AS eq_false, (code & 4) <> 0 AS truthy, (code & 8) <> 0 AS error
FROM (SELECT * REPLACE (CASE WHEN compiled AND case_pos IS NOT NULL THEN code END AS code) FROM verdicts)""",
    ),
    "kept_test_cases": (
        f"{_CASE_CTES} verdicts passes kept_cases",
        "SELECT instance_id, case_pos::INT AS case_pos, response, result FROM kept_cases",
    ),
    "verifier_pass_rates": (
        f"{_CASE_CTES} verdicts passes kept_cases rated",
        """SELECT instance_id, verifier_pos, passed::INT AS passed, cases::INT AS cases,
       passed * 5 >= cases * 4 AS kept FROM rated""",
    ),
    "filtered_instances": (
        f"{_KEPT_CTES} counters",
        """
SELECT i.instance_id, query, instruction,
  (SELECT string_agg(source, '|' ORDER BY verifier_pos) FROM kept_verifiers k WHERE k.instance_id = i.instance_id) AS verifiers,
  (SELECT string_agg(response || '=' || result::VARCHAR, '|' ORDER BY case_pos) FROM kept_cases k WHERE k.instance_id = i.instance_id) AS test_cases,
  verifiers_pass_80pct::INT AS verifiers_pass_80pct, total_passes::INT AS total_passes
FROM instances i JOIN counters USING (instance_id) WHERE unique_instances = 1""",
    ),
    "stored_instances": (
        f"{_KEPT_CTES} counters",
        """
SELECT instance_id, (row_number() OVER (PARTITION BY instance_id ORDER BY case_pos) - 1)::INT AS pos,
       response, result, total_passes::INT AS total_passes
FROM kept_cases JOIN counters USING (instance_id) WHERE unique_instances = 1""",
    ),
    "instance_counters": (
        f"{_KEPT_CTES} counters",
        "SELECT instance_id, " + ", ".join(f"{c}::INT AS {c}" for c in COUNTERS) + " FROM counters",
    ),
    "filter_funnel": (
        f"{_KEPT_CTES} counters",
        "SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS) + " FROM counters",
    ),
    "completion_verdicts": (
        f"opener instances verifiers instance_verifiers {_COMPLETED_CTES}",
        """
SELECT DISTINCT instance_id, verifier_pos, compiled,
       CASE WHEN compiled THEN slot::INT END AS input_pos,
       CASE WHEN compiled THEN (code & 4) <> 0 END AS truthy,
       CASE WHEN compiled THEN (code & 8) <> 0 END AS error
FROM completion_codes""",
    ),
    "stage_totals": (
        f"{_KEPT_CTES} counters",
        "SELECT " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTERS) + """,
       count(*) AS finished, 0::BIGINT AS timed_out, 0::BIGINT AS unfinished, count(*) AS written,
       sum(unique_instances)::BIGINT AS kept FROM counters""",
    ),
    "verdict_reuse": (
        _CASE_CTES,
        """
SELECT run::INT AS run, cells, distinct_pairs, CASE WHEN run = 0 THEN texts ELSE 0 END AS judged, texts AS known
FROM (SELECT count(*) AS cells, count(DISTINCT (source, response)) AS distinct_pairs,
             count(DISTINCT (source, response)) FILTER (response IS NOT NULL) AS texts
      FROM instance_verifiers v LEFT JOIN cases c USING (instance_id)), range(2) r(run)""",
    ),
    "completion_scores": (_RATE_CTES, "SELECT instance_id, slot::INT AS slot, rate FROM rates"),
    "labelled_completions": (
        _RATE_CTES,
        """
SELECT instance_id, label, completion,
       (row_number() OVER (PARTITION BY instance_id, label ORDER BY slot) - 1)::INT AS pos
FROM (SELECT *, CASE WHEN rate >= 0.5 THEN 'chosen' WHEN rate = 0 THEN 'rejected' END AS label FROM rates)
WHERE label IS NOT NULL""",
    ),
    "score_map": (
        f"{_RATE_CTES} score_map",
        """
SELECT instance_id, completion, score,
       (row_number() OVER (PARTITION BY instance_id ORDER BY first_slot) - 1)::INT AS pos
FROM score_map""",
    ),
    "stored_scores": (
        f"{_RATE_CTES} score_map",
        "SELECT instance_id, md5(completion) AS completion_md5, score FROM score_map",
    ),
    "yield_report": (
        _RATE_CTES,
        """
SELECT count(*) AS instances,
       sum(CASE WHEN least(c, r) > 0 THEN greatest(c, r) ELSE 0 END)::BIGINT AS pairs,
       sum(CASE WHEN least(c, r) > 0 THEN c + r ELSE 0 END)::BIGINT AS unique_completions,
       sum(CASE WHEN least(c, r) > 0 THEN 1 ELSE 0 END)::BIGINT AS unique_prompts,
       sum(c)::BIGINT AS chosen_completions, sum(r)::BIGINT AS rejected_completions
FROM (SELECT instance_id, count(*) FILTER (rate >= 0.5) AS c, count(*) FILTER (rate = 0) AS r
      FROM rates GROUP BY instance_id)""",
    ),
    "relabelled": (
        f"{_RATE_CTES} score_map",
        """
SELECT instance_id, md5(array_to_string(c, '|')) AS chosen_md5, md5(array_to_string(r, '|')) AS rejected_md5,
       len(c)::INT AS n_chosen, len(r)::INT AS n_rejected
FROM (SELECT instance_id,
        coalesce(list(completion ORDER BY first_slot) FILTER (score >= 0.25), []) AS c,
        coalesce(list(completion ORDER BY first_slot) FILTER (score < 0.5), []) AS r
      FROM score_map GROUP BY instance_id)""",
    ),
    "preference_pairs": (_PAIR_CTES, "SELECT instance_id, pair_idx, prompt, chosen, rejected FROM pairs"),
    "bounded_pairs": (
        f"{_RATE_CTES} score_map",
        "SELECT instance_id, pair_idx, prompt, chosen, rejected FROM ("
        + _pairs("score_map", "least(greatest(nc, nr), 2 * least(nc, nr))") + ")",
    ),
    "self_consistent_pairs": (
        f"{_KEPT_CTES} {_COMPLETED_CTES} kept_rates kept_score_map kept_pairs",
        "SELECT instance_id, pair_idx, prompt, chosen, rejected FROM kept_pairs",
    ),
    "token_views": (
        f"{_PAIR_CTES} view_tokens view_rows vocabulary views",
        "SELECT instance_id, pair_idx, "
        + _view_columns(lambda v: f"{_md5(v)} AS ids_md5_{v}") + ", "
        + _view_columns(lambda v: f"len({v})::INT AS len_{v}")
        + ", (len(chosen) - len(context))::INT AS completion_len_chosen FROM views",
    ),
    "vocabulary_views": (
        f"{_PAIR_CTES}",
        "SELECT instance_id, pair_idx, "
        + ", ".join(
            f"md5({text}) AS text_md5_{view}, ((length({text}) - length(replace({text}, {lit(STYLE.turn_end)}, '')))"
            f" // length({lit(STYLE.turn_end)}))::INT AS turns_{view}, true AS known_{view}"
            for view, text in _VIEW_TEXTS.items()
        ) + " FROM pairs",
    ),
    "padded_batches": (
        f"{_PAIR_CTES} view_tokens view_rows vocabulary views batched longest",
        f"SELECT instance_id, pair_idx, batch_id, batch_pos, {_PAD_IDS}, {_PAD_MASKS}, "
        + _view_columns(lambda v: f"max_{v}::INT AS padded_{v}") + " FROM longest",
    ),
    "epoch_batches": (
        f"{_PAIR_CTES} epochs walk",
        f"""
SELECT instance_id, pair_idx, epoch::INT AS epoch, x // {BATCH_SIZE} AS batch_id, (x % {BATCH_SIZE})::INT AS batch_pos
FROM walk WHERE x < n""",
    ),
    "dpo_metrics": (
        "sums metrics",
        "SELECT batch_id, " + _rounded("dpo_loss", "pi_margin", "ref_margin", "dpo_accuracy")
        + ", round(pi_margin - ref_margin, 6) + 0.0 AS margin_delta, round(dpo_loss, 6) + 0.0 AS loss FROM metrics",
    ),
    "dpo_metrics_nll": (
        "sums metrics_1",
        "SELECT batch_id, " + _rounded("dpo_loss")
        + ", round(nll, 6) + 0.0 AS chosen_nll_loss, round(dpo_loss + nll, 6) + 0.0 AS loss FROM metrics_1",
    ),
    "token_shift_scores": (
        "shift",
        """
SELECT conv_id, turn, md5(string_agg(token, ' ' ORDER BY pos)) AS tokens_md5, count(*)::INT AS n,
       round(sum(score), 6) + 0.0 AS total, (count(*) FILTER (score = 1))::INT AS clipped_up
FROM shift GROUP BY conv_id, turn""",
    ),
    "token_shift_table": (
        "shift",
        """
SELECT conv_id, turn, pos::INT AS pos, token, round(score, 6) + 0.0 AS score,
       CASE WHEN score > 0 THEN 'up' WHEN score < 0 THEN 'down' ELSE 'none' END AS direction FROM shift""",
    ),
    "token_shift_rollup": (
        "shift",
        "SELECT token, round(sum(score), 6) + 0.0 AS total_score, count(*) AS n FROM shift GROUP BY token",
    ),
    "if_scorecard": (
        "",
        f"""
SELECT {_rounded("prompt_strict_acc", "inst_strict_acc", "prompt_loose_acc", "inst_loose_acc")},
       round((prompt_strict_acc + inst_strict_acc + prompt_loose_acc + inst_loose_acc) / 4, 6) + 0.0 AS average
FROM (SELECT avg(all_strict::INT) AS prompt_strict_acc, avg(all_loose::INT) AS prompt_loose_acc
      FROM (SELECT bool_and(quality = 1) AS all_strict, bool_and(quality = 1 OR toxic = 0) AS all_loose
            FROM labels GROUP BY doc_id // 3)),
     (SELECT avg((quality = 1)::INT) AS inst_strict_acc, avg((quality = 1 OR toxic = 0)::INT) AS inst_loose_acc
      FROM labels)""",
    ),
    "choice_scorecard": ("", _CHOICE_CARD.format(_CHOICES)),
    "limited_scorecard": (
        "",
        _CHOICE_CARD.format(
            f"SELECT * FROM ({_CHOICES}) WHERE item_id IN "
            f"(SELECT DISTINCT doc_id // 4 AS item FROM documents ORDER BY item LIMIT 25)"
        ),
    ),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (needed, select) in _STATEMENTS.items():
        ctes = ",\n".join(f"{c} AS ({CTES[c]})" for c in needed.split())
        recursive = "RECURSIVE " if "walk" in needed.split() else ""
        out[name] = f"WITH {recursive}{ctes}\n{select}" if ctes else select.strip()
    for way in ("balanced_verdicts", "table_verdicts"):
        out[way] = out["completion_verdicts"]
    return out
