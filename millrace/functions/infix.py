"""Expressions written as text: names, constants, + - * /, unary minus, one comparison, and in / not in lists."""

from __future__ import annotations

import ast

from ..errors import SemanticError

BINARY = {ast.Add: "add", ast.Sub: "subtract", ast.Mult: "multiply", ast.Div: "divide"}
COMPARE = {ast.Eq: "is", ast.NotEq: "not", ast.Gt: "gt", ast.GtE: "gte", ast.Lt: "lt", ast.LtE: "lte", ast.In: "is", ast.NotIn: "not"}
MAX_DEPTH = 250


def parse(text: str, resolve) -> dict:
    """resolve(name) gives the expression of a name; a.b is one name."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise SemanticError("INVALID_EXPRESSION_AST", f"{text!r} isn't an expression") from e
    return _read(tree, text, resolve, 0)


def _read(node: ast.AST, text: str, resolve, depth: int) -> dict:
    bad = SemanticError("INVALID_EXPRESSION_AST", f"{ast.unparse(node)!r} isn't allowed in {text!r}")
    if depth > MAX_DEPTH:
        raise SemanticError("INVALID_EXPRESSION_AST", "the expression is too deep")
    if isinstance(node, ast.Constant):
        if not isinstance(node.value, (int, float, str)):
            raise bad
        return {"kind": "literal", "value": node.value}
    if isinstance(node, (ast.Name, ast.Attribute)):
        return resolve(ast.unparse(node))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return {"kind": "subtract", "args": [{"kind": "literal", "value": 0}, _read(node.operand, text, resolve, depth + 1)]}
    if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
        return {"kind": BINARY[type(node.op)], "args": [_read(x, text, resolve, depth + 1) for x in (node.left, node.right)]}
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in COMPARE:
        right = node.comparators[0]
        many = isinstance(node.ops[0], (ast.In, ast.NotIn))
        if many != isinstance(right, (ast.List, ast.Tuple)):
            raise bad
        try:
            value = ast.literal_eval(right)
        except ValueError:
            raise bad from None
        return {"kind": "comparison", "word": COMPARE[type(node.ops[0])], "args": [_read(node.left, text, resolve, depth + 1), list(value) if many else value]}
    raise bad
