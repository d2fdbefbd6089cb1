"""testsieve — Spark-native operators for judging machine-written test cases.

Every operator is a plain ``DataFrame -> DataFrame`` function with explicit
keys (dataset, llm, function_id, test_idx, task_id, ...).  Nothing is
collected to the driver; per-group work is expressed with ``groupBy`` /
windows / higher-order array functions so that Catalyst plans it.

Sub-packages
  sources/    readers, adapters onto the driver tables, sinks
  functions/  reusable Column expressions (entropy, regex helpers, pass@k)
  operators/  the DataFrame operators (text, tokens, features, selection,
              metrics, agreement, pass@k, learning, curation, parsing jobs)
  plans/      the registered queries (one per operator) and their SQL oracles
  streaming/  incremental scoring of arriving generations (reuses operators)
"""

__version__ = "0.1.0"
