"""The expression language: text to tree to typed Spark column."""

from .compiler import Env, Untranslatable, Value, translate, truthy
from .syntax import Node, SyntaxFault, parse, references

__all__ = ["Env", "Node", "SyntaxFault", "Untranslatable", "Value", "parse", "references", "translate", "truthy"]
