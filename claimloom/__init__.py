"""Facts, rules and provenance as Spark plans.

``FactSpace`` names relations, ``evaluate`` turns a rule body into one lazy DataFrame, and
the subpackages hold what surrounds it: the fact ledger and its views, rule composition,
what-if scenarios, explanations, uncertainty, audit files and a streaming view.
"""

from .plans.compile import FactSpace, evaluate
from .plans.ir import RuleError

__all__ = ["FactSpace", "RuleError", "evaluate"]
