"""Class hierarchies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def _c3(name: str, bases: dict, seen: tuple = (), known: dict | None = None) -> list[str]:
    """Orders once found are kept in `known`, so that diamonds are not searched again; what a cycle cut short is not kept."""
    known = {} if known is None else known
    if name in known:
        return known[name]
    if name in seen:
        known["\0cut"] = True
        return [name]
    own = [b for b in bases.get(name, [])]
    before = known.pop("\0cut", False)
    lists = [list(_c3(b, bases, (*seen, name), known)) for b in own] + [own]
    out = [name]
    while any(lists):
        head = next((x[0] for x in lists if x and not any(x[0] in y[1:] for y in lists)), None)
        if head is None:  # no consistent order: the rest by first sight
            for x in lists:
                out.extend(y for y in x if y not in out)
            break
        out.append(head)
        lists = [[y for y in x if y != head] for x in lists]
    if "\0cut" not in known:
        known[name] = out
    if before:
        known["\0cut"] = True
    return out


def linearize(classes: DataFrame) -> DataFrame:
    """(repo_id, name, linearization, overridden): C3 order of each class and its methods that a base defines as well.

    classes: (repo_id, name, bases, methods). One repository's hierarchy is one group; unknown bases stay as leaves, cycles are cut.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bases = {r["name"]: list(r.bases) if r.bases is not None else [] for _, r in pdf.iterrows()}
        methods = {r["name"]: set(r.methods) if r.methods is not None else set() for _, r in pdf.iterrows()}
        rows, known = [], {}
        for n in sorted(bases):
            known.pop("\0cut", None)
            order = _c3(n, bases, (), known)
            up = set().union(*[methods.get(b, set()) for b in order[1:]]) if len(order) > 1 else set()
            rows.append((pdf.repo_id.iloc[0], n, order, sorted(methods[n] & up)))
        return pd.DataFrame(rows, columns=["repo_id", "name", "linearization", "overridden"])

    return classes.groupBy("repo_id").applyInPandas(run, "repo_id string, name string, linearization array<string>, overridden array<string>")
