"""A read-only Cypher subset compiled to DataFrame plans."""

from weftgraph.cypher.compiler import run
from weftgraph.cypher.parser import CypherError, parse

__all__ = ["CypherError", "parse", "run"]
