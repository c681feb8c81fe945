"""Tag rules: condition trees compiled to one column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

OPS = ("and", "or", "not")


def _field(args: dict) -> Column:
    c, op, v = F.col(args["field"]), args.get("op", "eq"), args.get("value")
    if op == "eq":
        return c.eqNullSafe(F.lit(v))
    if op == "ne":
        return ~c.eqNullSafe(F.lit(v))  # a missing value differs
    if op == "in":
        return F.coalesce(c.isin(*[x for x in v if x is not None]), F.lit(None in v))
    test = {"gte": lambda: c >= v, "lte": lambda: c <= v, "like": lambda: F.lower(c.cast("string")).contains(str(v).lower())}[op]()
    return F.coalesce(test, F.lit(False))


def _near(text: Column, args: dict) -> Column:
    """Two words within so many words of each other."""
    t, a, b, w = tokens(text), args["first"].lower(), args["second"].lower(), int(args["within"])
    places = lambda word: F.filter(F.transform(t, lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())
    return F.exists(places(a), lambda i: F.exists(places(b), lambda j: F.abs(i - j) <= w))


def predicate(name: str, args: dict, text: str = "text") -> Column:
    t = F.coalesce(F.col(text), F.lit("")) if name != "field" else None
    if name == "literal":
        return F.lower(t).contains(args["value"].lower())
    if name == "regex":
        return t.rlike("(?i)" + args["pattern"])
    if name == "grep_like":
        return t.rlike(r"(?i)\b" + re.escape(args["value"]) + r"\b")
    if name == "near":
        return _near(t, args)
    if name == "field":
        return _field(args)
    raise ValueError(f"unknown predicate {name!r}")


def compile_tree(node: dict, text: str = "text") -> Column:
    """{op: and|or|not, children: [...]} or {predicate: ..., args: ...}; not of several is the negation of all of them together."""
    if "predicate" in node:
        return predicate(node["predicate"], node.get("args", {}), text)
    if node.get("op") not in OPS:
        raise ValueError(f"unknown op {node.get('op')!r}")
    parts = [compile_tree(c, text) for c in node.get("children", [])]
    if node["op"] == "or":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    both = reduce(lambda a, b: a & b, parts, F.lit(True))
    return ~both if node["op"] == "not" else both


def validate_tree(node: dict) -> list[str]:
    """What is wrong with a tree; an empty list if nothing is."""
    if "predicate" in node:
        if node["predicate"] not in ("literal", "regex", "grep_like", "near", "field"):
            return [f"unknown predicate {node['predicate']!r}"]
        if node["predicate"] == "regex":
            try:
                re.compile(node.get("args", {}).get("pattern", ""))
            except re.error as e:
                return [f"bad pattern: {e}"]
        return []
    if node.get("op") not in OPS:
        return [f"unknown op {node.get('op')!r}"]
    return [x for c in node.get("children", []) for x in validate_tree(c)]


def apply_rule(docs: DataFrame, tree: dict, tag: str, existing: DataFrame, rule_id: int = 0, doc_id: str = "doc_id") -> DataFrame:
    """Tags after a run of a rule: its old rows are replaced, and a manual row of the same tag stays instead."""
    found = docs.filter(compile_tree(tree)).select(doc_id, F.lit(tag).alias("tag"), F.lit("rule").alias("added_by"), F.lit(rule_id).cast("long").alias("rule_id"))
    kept = existing.filter(~((F.col("added_by") == "rule") & (F.col("rule_id") == rule_id)))
    manual = kept.filter(F.col("added_by") == "manual").select(doc_id, "tag")
    return kept.unionByName(found.join(manual, [doc_id, "tag"], "left_anti").select(*kept.columns))


def tag_cache(tags: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return tags.groupBy(doc_id).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
