"""Documents to packed sequences in five stages: STAGES has (name, function), run() applies them to the documents of a folder.

The stages themselves, what they do with odd rows and why there is no ORACLE_SQL are in termweave/llm/stages.py.
"""

from __future__ import annotations

from termweave.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
