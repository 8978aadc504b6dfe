"""Recursive-descent parsers that collect all syntax errors of a source text."""

from codestrata.llm.syntax.check import LANGUAGES, syntax_errors

__all__ = ["LANGUAGES", "syntax_errors"]
