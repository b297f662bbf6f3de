"""The derived tables again, as ANSI SQL over the same Parquet files, for checking results."""

from __future__ import annotations

from quizlake import fixed_values as fv


def quote(text: str) -> str:
    """A SQL string literal; line breaks are spliced in."""
    pieces = []
    for i, line in enumerate(text.split("\n")):
        if i:
            pieces.append("chr(10)")
        if line or not i:
            pieces.append("'" + line.replace("'", "''") + "'")
    return pieces[0] if len(pieces) == 1 else "(" + " || ".join(pieces) + ")"


VIEWS: dict[str, str] = {
    "mcq": """
        SELECT p_partkey AS item_id,
               'What size is the ' || p_name || ' of ' || p_brand || '?' AS question,
               list_transform([0,1,2,3,4], lambda j:
                   chr(CAST(65+j AS INTEGER)) || ')' || (p_size + j - p_partkey % 5)) AS options,
               chr(CAST(65 + p_partkey % 5 AS INTEGER)) AS correct,
               'The listed size is ' || p_size || '.' || chr(10) || chr(10) || 'The answer is: '
                   || chr(CAST(65 + p_partkey % 5 AS INTEGER)) AS rationale,
               lower(p_type) AS kind
        FROM part""",
    "mcq_raw": """
        SELECT item_id, question,
               CASE item_id % 50
                    WHEN 0 THEN substr(CAST(to_json(options) AS VARCHAR), 1,
                                       length(CAST(to_json(options) AS VARCHAR)) - 3)
                    WHEN 1 THEN CAST(to_json(options[1:4]) AS VARCHAR)
                    WHEN 3 THEN CAST(to_json(list_concat(['A)say "x"'], options[2:5])) AS VARCHAR)
                    WHEN 4 THEN '[null,' || substr(CAST(to_json(options[2:5]) AS VARCHAR), 2)
                    ELSE CAST(to_json(options) AS VARCHAR) END AS options_json,
               CASE WHEN item_id % 50 = 2 THEN 'F' ELSE correct END AS correct
        FROM mcq""",
    "parsed": """
        SELECT *, CASE WHEN json_valid(options_json)
                       THEN from_json(options_json, '["VARCHAR"]') END AS options
        FROM mcq_raw""",
    "responses": """
        SELECT response_id, item_id, run,
               CASE response_id % 7
                    WHEN 0 THEN 'Answer: ' || l
                    WHEN 1 THEN 'Step one.' || chr(10) || 'The answer is ' || l || '.'
                    WHEN 2 THEN 'the correct option is: ' || lower(l)
                    WHEN 3 THEN 'Output: Answer: A' || chr(10) || 'Output: answer is ' || l
                    WHEN 4 THEN 'It costs 1,234.50, answer is **' || l || '**'
                    WHEN 5 THEN 'I cannot tell' END AS response
        FROM (SELECT o_orderkey AS response_id, o_custkey AS item_id,
                     'run_' || lower(o_orderstatus) AS run,
                     chr(64 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS l
              FROM orders)""",
    "talk": """
        SELECT conv_id, turn, text || CASE turn % 4
                    WHEN 1 THEN ' Answer: ' || l
                    WHEN 2 THEN ' Answer: A' || chr(10) || 'the correct option is: ' || lower(l)
                    WHEN 3 THEN ' (the ANSWER IS ' || l || ')' ELSE '' END AS text
        FROM (SELECT *, chr(CAST(65 + conv_id % 5 AS INTEGER)) AS l FROM conversations)""",
    "strict_responses": """
        SELECT response_id, item_id, run,
               CASE response_id % 4
                    WHEN 0 THEN 'By steps.' || chr(10) || 'The correct answer is ' || l || '.'
                    WHEN 1 THEN 'the CORRECT answer is ' || lower(l) || ' or so'
                    WHEN 2 THEN 'The correct answer is: ' || l END AS response
        FROM (SELECT o_orderkey AS response_id, o_custkey AS item_id,
                     'run_' || lower(o_orderstatus) AS run,
                     chr(64 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS l
              FROM orders)""",
    "few_shot_responses": """
        SELECT response_id, item_id, run, response_id % 3 AS shots,
               repeat('Instruction: q options: A)1' || chr(10) || 'Output: Answer: A' || chr(10)
                      || chr(10), response_id % 3) || response AS response
        FROM responses""",
    "numeric_responses": """
        SELECT o_orderkey AS response_id, 'run_' || lower(o_orderstatus) AS run,
               CASE o_orderkey % 7
                    WHEN 0 THEN 'The total is ' || format('{:,}', p)
                    WHEN 1 THEN 'So it is ' || (p + 1)
                    WHEN 2 THEN '2 steps, about ' || p || '.'
                    WHEN 3 THEN 'Balance: -' || p
                    WHEN 4 THEN 'Roughly ' || p || 'e0'
                    WHEN 5 THEN 'no number here' END AS response,
               'Working. #### ' || format('{:,}', p) AS answer
        FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)""",
    "numeric_items": """
        SELECT o_orderkey AS item_id, 'What does order ' || o_orderkey || ' cost?' AS question,
               'Working. #### ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS answer
        FROM orders""",
    "rationales": """
        SELECT *, chr(10) || ' ' || rationale || CASE item_id % 3
                    WHEN 0 THEN ''
                    WHEN 1 THEN chr(10) || chr(10) || 'First, so to say, The answer is: near.'
                                || chr(10) || chr(10) || 'Then check it.'
                    ELSE chr(10) || chr(10) || 'Check it.' || chr(10) || '  ' END AS LLMs_rationale
        FROM mcq""",
    "predictions": """
        SELECT l_partkey AS item_id, lower(l_returnflag) AS run,
               CAST(l_quantity AS BIGINT) % 5 AS choice, l_linenumber = 7 AS silent
        FROM lineitem""",
    "grid_responses": """
        SELECT run, shots, item_id,
               CASE WHEN shots = 'zero_shot' THEN 0 ELSE 1 END AS n_shot,
               CASE WHEN shots = 'zero_shot' THEN ''
                    ELSE 'Output: Answer: B' || chr(10) || chr(10) END ||
               CASE WHEN l_suppkey % 4 = 0 THEN 'not sure'
                    ELSE 'Answer: ' || chr(CAST(65 + CAST(l_quantity AS INTEGER) % 5 AS INTEGER))
                    END AS response
        FROM (SELECT *, l_partkey AS item_id,
                     CASE WHEN l_returnflag = 'A' THEN
                            'org/phi-1_5-finetuned-maths'
                            || CASE WHEN l_linestatus = 'O' THEN '-AM' ELSE '' END || '-'
                            || (['0.5','1','2','3','4','5','2'])[l_linenumber] || 'k'
                            || CASE WHEN l_linenumber = 7 THEN '-alpha-24' ELSE '' END
                          WHEN l_returnflag = 'R' THEN
                            'org/phi-1_5-finetuned-maths-AM-teacher-2k-r-' || (l_linenumber * 8)
                          ELSE CASE WHEN l_linestatus = 'F' THEN 'kd_' ELSE '' END
                            || CASE WHEN l_discount > 0.05 THEN 'lora' ELSE 'full' END
                            || '_finetune_t5-small_custom' || (l_linenumber * 500) END AS run,
                     CASE WHEN l_tax < 0.03 THEN 'zero_shot'
                          WHEN l_tax < 0.06 THEN 'one_shot'
                          WHEN l_tax < 0.08 THEN 'one_shot_cot' ELSE 'two_shot' END AS shots
              FROM lineitem)""",
}

NEEDS: dict[str, list[str]] = {
    "mcq_raw": ["mcq"],
    "parsed": ["mcq_raw"],
    "few_shot_responses": ["responses"],
    "rationales": ["mcq"],
}


def query(body: str, *views: str, **extra: str) -> str:
    """``body`` under a WITH clause of the named derived tables and any extra ones."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    clauses = [f"{name} AS ({VIEWS[name]})" for name in ordered]
    clauses += [f"{name} AS ({text})" for name, text in extra.items()]
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + body


# Text rules in SQL. Case is ignored by (?i); RE2 knows no u flag.
def letters(text: str) -> str:
    return f"regexp_extract_all({text}, {quote('(?i)' + fv.LAST_LETTER)}, 1)"


def last_letter(text: str) -> str:
    return f"upper({letters(text)}[-1])"


def last_letter_after(text: str, shots: str) -> str:
    return f"CASE WHEN len({letters(text)}) > {shots} THEN upper({letters(text)}[-1]) END"


def clean_letter(text: str) -> str:
    cleaned = f"regexp_replace(lower({text}), {quote(fv.NOT_WORD_SPACE_COLON_BRACKET)}, '', 'g')"
    colon = rf"'(?i)answer{fv.SPACE}*:{fv.SPACE}*([a-e])'"
    plain = f"'(?i){fv.CLEAN_IS_LETTER}'"
    return (
        f"upper(coalesce(nullif(regexp_extract({cleaned}, {colon}, 1), ''),"
        f" nullif(regexp_extract({cleaned}, {plain}, 1), '')))"
    )


def letter_after_phrase(text: str) -> str:
    tail = f"substr({text}, instr({text}, 'answer is') + 9)"
    return (
        f"CASE WHEN instr({text}, 'answer is') > 0"
        f" THEN upper(nullif(regexp_extract({tail}, '(?i)([A-E])', 1), '')) END"
    )


def strict_letter(text: str) -> str:
    found = f"regexp_extract({text}, '(?i){fv.STRICT_PHRASE}', 1)"
    return f"CASE WHEN {text} IS NOT NULL THEN coalesce(upper(nullif({found}, '')), 'N/A') END"


def last_number_text(text: str) -> str:
    joined = f"regexp_replace({text}, '{fv.DIGIT_COMMA_DIGIT}', '\\1\\2', 'g')"
    return f"replace(regexp_extract_all({joined}, '{fv.NUMBER}')[-1], ',', '')"


def normalised(text: str) -> str:
    return f"translate(lower({text}), {quote(fv.PUNCTUATION)}, '')"


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{fv.TOKEN_SEPARATOR}'), lambda t: t <> '')"


def seeded(seed: int | str, *keys: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || ':' || {key}" for key in keys) + ")"


def number_of(hash_text: str) -> str:
    return f"CAST('0x' || substr({hash_text}, 1, 15) AS BIGINT)"
