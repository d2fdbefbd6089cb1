"""The adapter views of ``sources/adapters.py`` written in SQL for the DuckDB
oracle (tables region … conversations are pre-registered views there).

``with_views("scores_v", ...)`` returns a ``WITH`` clause holding the named
views and their dependencies in order; oracle queries append their SELECT.
"""

from __future__ import annotations

_VOCAB = "['assert', ' f', '(', '1', ',', ' ', '2', ')', ' ==', '3', '\"a\"', '[', ']', 'x', ' 7', '0']"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "generations_v": ((), f"""
        SELECT CASE WHEN (vec_id % 50) % 2 = 0 THEN 'HumanEval' ELSE 'MBPP' END AS dataset,
               CASE WHEN (vec_id % 50) % 5 < 3 THEN 'gpt-4o' ELSE 'codeqwen' END AS llm,
               vec_id % 50 AS function_id, vec_id AS test_idx,
               CASE WHEN label < 7 THEN 1 ELSE 0 END AS is_valid, embedding
        FROM embeddings"""),
    "tokens_v": (("generations_v",), f"""
        SELECT g.dataset, g.llm, g.function_id, g.test_idx, g.is_valid, CAST(t.p AS INTEGER) AS pos,
               {_VOCAB}[((g.test_idx * 3 + t.p * 5) % 16) + 1] AS token,
               abs(CAST(g.embedding[4 * t.p + 1] AS DOUBLE)) * -10.0 AS logprob,
               CASE WHEN t.p < 12 THEN 'input' ELSE 'output' END AS section,
               list_transform(range(4), lambda j: {{'token': {_VOCAB}[((g.test_idx * 3 + t.p * 5 + j) % 16) + 1],
                                                    'logprob': abs(CAST(g.embedding[4 * t.p + j + 1] AS DOUBLE)) * -10.0}}) AS top
        FROM generations_v g, range(16) t(p)"""),
    "response_tokens_v": ((), f"""
        SELECT vec_id AS response_id, vec_id % 50 AS function_id, CAST(t.p AS INTEGER) AS pos,
               CASE WHEN t.p = 0 THEN 'Tests: assert' ELSE {_VOCAB}[((vec_id * 3 + ((t.p - 1) % 16) * 5) % 16) + 1] END AS token
        FROM embeddings, range(33) t(p)"""),
    "response_tests_v": ((), f"""
        SELECT vec_id AS response_id, vec_id % 50 AS function_id, vec_id * 8 + t.n AS test_idx, t.n,
               CASE WHEN (vec_id + t.n) % 7 = 3 THEN 'not in it'
                    ELSE array_to_string(list_transform(range(3), lambda j: {_VOCAB}[((vec_id * 3 + ((t.n % 4) * 4 + j) * 5) % 16) + 1]), '') END AS input_text,
               CASE WHEN (vec_id + t.n) % 11 <> 5 THEN {_VOCAB}[((vec_id * 3 + ((t.n % 4) * 4 + 3) * 5) % 16) + 1] END AS output_text
        FROM embeddings, range(8) t(n)"""),
    "scores_v": ((), """
        SELECT user_id AS function_id, event_id AS test_idx, least(value / 100.0, 1.0) AS y_prob,
               CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS y_true
        FROM events"""),
    "exec_rows_v": ((), """
        SELECT CAST(user_id AS VARCHAR) AS task_id, event_id, CAST(event_id % 7 AS INTEGER) AS solution_id,
               CAST(CAST(round(value * 100) AS BIGINT) % 3 AS INTEGER) AS test_id,
               event_type <> 'error' AS ok, least(value / 100.0, 1.0) AS score
        FROM events"""),
    "exec_v": (("exec_rows_v",), """
        SELECT task_id, solution_id, test_id, bool_and(ok) AS passed
        FROM exec_rows_v GROUP BY task_id, solution_id, test_id"""),
    "solutions_v": (("exec_rows_v",), """
        SELECT task_id, event_id AS sample_idx, solution_id,
               'def solution_' || CAST(solution_id AS VARCHAR) || '(): pass' AS completion
        FROM exec_rows_v"""),
    "tests_v": (("exec_rows_v",), """
        SELECT task_id, solution_id AS sample_idx, event_id // 7 AS pos,
               test_id, 'assert candidate(' || CAST(test_id AS VARCHAR) || ')' AS text, score
        FROM exec_rows_v"""),
    "ground_truth_v": (("exec_v",), """
        SELECT task_id, solution_id, bool_and(passed) AS passed FROM exec_v GROUP BY task_id, solution_id"""),
    "outcomes_v": ((), """
        SELECT user_id AS function_id, event_id AS test_idx,
          CASE WHEN event_type <> 'error' THEN 'Ran tests. OK (tests=' || CAST(event_id % 5 + 1 AS VARCHAR) || ')'
               WHEN event_id % 11 = 0 THEN 'AssertionError: assert f(' || CAST(event_id AS VARCHAR) || ') then TypeError'
               WHEN event_id % 11 = 1 THEN 'SyntaxError: invalid syntax'
               WHEN event_id % 11 = 2 THEN 'IndentationError: unexpected indent'
               WHEN event_id % 11 = 3 THEN 'TypeError: unsupported operand'
               WHEN event_id % 11 = 4 THEN 'ValueError: invalid literal'
               WHEN event_id % 11 = 5 THEN 'AttributeError: object has no attribute'
               WHEN event_id % 11 = 6 THEN 'ModuleNotFoundError: No module named x'
               WHEN event_id % 11 = 7 THEN 'ImportError: cannot import name y'
               WHEN event_id % 11 = 8 THEN 'NameError: name z is not defined'
               WHEN event_id % 11 = 9 THEN 'FileNotFoundError: no such file'
               WHEN event_id % 2 = 0 THEN 'FAILED (failures=' || CAST(event_id % 3 AS VARCHAR) || ', errors='
                                          || CAST(event_id % 4 AS VARCHAR) || ')'
               ELSE 'FAILED (failures=1)' END AS output
        FROM events"""),
    "hits_v": ((), """
        SELECT l_orderkey AS function_id, CAST(l_partkey % 4 AS INTEGER) AS test_idx, l_linenumber AS line_no,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS valid
        FROM lineitem"""),
    "hit_tests_v": (("hits_v",), """
        SELECT function_id, test_idx, max(valid) AS is_valid FROM hits_v GROUP BY function_id, test_idx"""),
    "hit_functions_v": ((), """
        SELECT o_orderkey AS function_id, 10 AS total_lines FROM orders"""),
    "mutants_v": ((), """
        SELECT 'mod' || CAST(l_suppkey AS VARCHAR) AS module, l_orderkey AS run_id, l_linenumber AS step,
          CASE WHEN l_linenumber = 7 THEN 'timeout'
               WHEN l_linenumber = 6 AND l_linestatus = 'O' THEN 'suspicious'
               WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linestatus = 'F') THEN 'killed'
               WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'skipped'
               ELSE 'survived' END AS status
        FROM lineitem"""),
    "mutant_results_v": (("mutants_v",), """
        SELECT module,
               CAST(sum(CASE WHEN status = 'killed' THEN 1 ELSE 0 END) AS BIGINT) AS killed,
               CAST(sum(CASE WHEN status = 'timeout' THEN 1 ELSE 0 END) AS BIGINT) AS timeout,
               CAST(sum(CASE WHEN status = 'suspicious' THEN 1 ELSE 0 END) AS BIGINT) AS suspicious,
               CAST(sum(CASE WHEN status = 'survived' THEN 1 ELSE 0 END) AS BIGINT) AS survived,
               CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) AS BIGINT) AS skipped
        FROM mutants_v GROUP BY module"""),
    "mutation_log_v": (("mutants_v",), """
        SELECT module, run_id, string_agg(line, chr(10) || 'running mutants' || chr(10) ORDER BY step) AS log
        FROM (
          SELECT module, run_id, step,
            '⠋ ' || CAST(step AS VARCHAR) || '/' || CAST(count(*) OVER (PARTITION BY module, run_id) AS VARCHAR)
            || '  🎉 ' || CAST(sum(CASE WHEN status = 'killed' THEN 1 ELSE 0 END) OVER w AS VARCHAR)
            || ' ⏰ ' || CAST(sum(CASE WHEN status = 'timeout' THEN 1 ELSE 0 END) OVER w AS VARCHAR)
            || ' 🤔 ' || CAST(sum(CASE WHEN status = 'suspicious' THEN 1 ELSE 0 END) OVER w AS VARCHAR)
            || ' 🙁 ' || CAST(sum(CASE WHEN status = 'survived' THEN 1 ELSE 0 END) OVER w AS VARCHAR)
            || ' 🔇 ' || CAST(sum(CASE WHEN status = 'skipped' THEN 1 ELSE 0 END) OVER w AS VARCHAR) AS line
          FROM mutants_v
          WINDOW w AS (PARTITION BY module, run_id ORDER BY step)
        ) GROUP BY module, run_id"""),
    "corpus_v": ((), """
        SELECT d.source AS function_id, d.doc_id AS test_idx, l.quality AS is_valid, d.text
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "dialog_v": ((), """
        SELECT conv_id, turn, text AS prompt, next_text AS response FROM (
          SELECT conv_id, turn, role, text,
                 lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
          FROM conversations) WHERE role = 'user' AND next_role = 'assistant'"""),
    "revisions_v": ((), """
        SELECT source AS function_id, doc_id AS test_idx,
               CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', '  ')
                    WHEN doc_id % 3 = 1 THEN replace(text, '.', ';') END AS validated_text
        FROM documents"""),
}


def with_views(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n"
