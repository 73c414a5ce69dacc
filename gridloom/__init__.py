"""gridloom: a Spark-native engine for table-structure records.

Grids of spanning cells, their labels, governance, isolation and sealing are
expressed as DataFrame plans; training-data operators for general data live in
``gridloom.operators`` and those for language-model corpora in ``gridloom.llm``.
"""

__version__ = "0.1.0"

from gridloom.operators.govern import COMPLETE_TABLE, EXPLICIT, complete_candidates, explicit_candidates, replay, select_complete_table, select_explicit

__all__ = ["COMPLETE_TABLE", "EXPLICIT", "complete_candidates", "explicit_candidates", "replay", "select_complete_table", "select_explicit"]
