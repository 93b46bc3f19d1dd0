"""Gradients of proof counts with respect to stored relations.

The plan is walked backwards once.  Deltas of a node that feeds several others
are added up, and every adjoint is exact.  A parameter's gradient keeps to the
facts there are, and so a delta to the rows of its node's message; ``densify``
gives every pair that the outer product reaches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.hubs import met
from weft.operators.lower import NONE, Evaluation, Split, added, keys_of, product, step, totals
from weft.operators.plugins import NoAdjoint
from weft.plans.nodes import Node, in_order
from weft.scratch import written

#: What tells the rows of a parameter apart, by its arity; 0 is that of vectors, one row a component.
KEYS = {2: ["src", "dst"], 1: ["id"], 0: ["id", "k"]}


def _fold(delta: DataFrame, like: Node) -> DataFrame:
    """A delta for a node without query: the sum over queries."""
    if like.per_query or "qid" not in delta.columns:
        return delta
    return delta.groupBy("id").agg(F.sum("w").alias("w"))


def _spread(message: DataFrame, ev: Evaluation) -> DataFrame:
    return message if "qid" in message.columns else ev.queries.crossJoin(message).select("qid", "id", "w")


def _holding(node: Node, ev: Evaluation) -> DataFrame:
    """Rows that a node's message keeps to, and perhaps others, where these come
    without making it: those of the batch that it is multiplied with.  A row
    that the message lacks meets no fact further back.  Plugins are to get no such rows."""
    if node.kind == "product" and any(i.kind == "input" for i in node.inputs) and all(n.kind != "plugin" for n in in_order(node)):
        return ev.batch
    return ev.of(node)


def outer(message: DataFrame, delta: DataFrame, relation: DataFrame, forward: bool, densify: bool, split: Split = NONE) -> DataFrame:
    """(src, dst, w): sum over queries of message at the near end times delta at the far end."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    on = [c for c in ("qid",) if c in message.columns and c in delta.columns]
    m = message.select(*on, F.col("id").alias(near), F.col("w").alias("mw"))
    d = delta.select(*on, F.col("id").alias(far), F.col("w").alias("dw"))
    if densify:
        both = m.join(d, on) if on else m.crossJoin(d)
    else:
        both = met(m, relation.select("src", "dst"), near, split.left, split.right, split.rows).join(d, [*on, far])
    return both.groupBy("src", "dst").agg(F.sum(F.col("mw") * F.col("dw")).alias("w"))


def stepped_back(message: DataFrame, delta: DataFrame, relation: DataFrame, forward: bool, split: Split = NONE) -> DataFrame:
    """The delta of a step's message, where that has rows.

    The message goes along the relation, as in the step itself, and each fact
    that it meets takes the delta at its far end.  So no more rows are made than
    the step makes; the delta alone, stepped back, would reach every symbol
    with a fact at that end, for each query.
    """
    near, far = ("src", "dst") if forward else ("dst", "src")
    on = [c for c in ("qid",) if c in message.columns and c in delta.columns]
    rel = relation.select(F.col(near).alias("id"), F.col(far).alias("to"), F.col("w").alias("rw"))
    d = delta.select(*on, F.col("id").alias("to"), F.col("w").alias("dw"))
    both = met(message.select(*on, "id"), rel, "id", split.left, split.right, split.rows).join(d, [*on, "to"])
    return both.groupBy(*on, "id").agg(F.sum(F.col("dw") * F.col("rw")).alias("w"))


def gradients(ev: Evaluation, root: Node, delta: DataFrame, parameters: set[tuple[str, int]], densify: bool = False, seen: list[tuple[Node, DataFrame]] | None = None) -> dict[tuple[str, int], DataFrame]:
    """For each parameter that the plan uses, the sum of its gradients over all queries.

    ``delta`` is (qid, id, w), the loss's derivative by the root's value.
    ``seen`` takes each node that the walk reaches, with its delta.
    """
    order = list(in_order(root))
    deltas: dict[int, list[DataFrame]] = {id(root): [delta]}
    found: dict[tuple[str, int], list[DataFrame]] = {}
    useful = _reaching(order, parameters, ev.plugins)

    def send(to: Node, what: DataFrame) -> None:
        if id(to) in useful:
            folded = _fold(what, to)
            # at most a row a symbol: stored, it is what moves to the facts, which stay where they are
            deltas.setdefault(id(to), []).append(folded if folded is what or to.kind != "step" else written(folded, "folded"))

    for node in reversed(order):
        if id(node) not in deltas or id(node) not in useful:
            continue
        d = added(deltas[id(node)], ev.queries)
        r = ev.relations
        if seen is not None:
            seen.append((node, d))
        match node.kind:
            case "step":
                functor, forward = node.detail[0], node.detail[1] == "forward"
                if (functor, 2) in parameters:
                    found.setdefault((functor, 2), []).append(outer(ev.of(node.inputs[0]), d, r.binary(functor), forward, densify, ev.split(node.inputs[0], *node.detail)))
                if id(node.inputs[0]) in useful and (densify or not node.per_query):  # with densify, facts that aren't there have gradients too
                    back = step(d, r.binary(functor), not forward, ev.split(None, functor, "backward" if forward else "forward"))
                    # without queries at most as many rows as facts: summed before they meet the message's, which are unique; a semi-join would be taken before the sum
                    send(node.inputs[0], back if densify else back.join(ev.of(node.inputs[0]).select("id"), "id"))
                elif id(node.inputs[0]) in useful:
                    send(node.inputs[0], stepped_back(ev.of(node.inputs[0]), d, r.binary(functor), forward, ev.split(node.inputs[0], *node.detail)))
            case "product":
                a, b = node.inputs
                send(a, product(d, ev.of(b)))
                send(b, product(d, ev.of(a)))
            case "scale":
                value, by = node.inputs
                d = _spread(d, ev) if node.per_query else d
                total, on = totals(ev.of(by)), ["qid"] if by.per_query else []
                scaled = d.join(total, on) if on else d.crossJoin(F.broadcast(total))
                send(value, scaled.select(*keys_of(d), (F.col("w") * F.col("total")).alias("w")))
                if id(by) in useful:
                    both = totals(product(d, ev.of(value)))
                    held = ev.of(by) if densify or seen is not None else _holding(by, ev)
                    members = held.select(*keys_of(held))
                    joined = members.join(both, "qid") if "qid" in members.columns and "qid" in both.columns else members.crossJoin(both)
                    cols = [c for c in ("qid", "id") if c in joined.columns]
                    send(by, joined.select(*cols, F.col("total").alias("w")))
            case "sum":
                for i in node.inputs:
                    send(i, d)
            case "unary":
                if (node.detail[0], 1) in parameters:
                    found.setdefault((node.detail[0], 1), []).append(_fold(d, node) if densify else product(_fold(d, node), r.unary(node.detail[0]).select("id", F.lit(1.0).alias("w"))))
            case "preimage":
                if (node.detail[0], 2) in parameters:
                    near = "src" if node.detail[1] == "forward" else "dst"
                    at = _fold(d, node).select(F.col("id").alias(near), "w")
                    found.setdefault((node.detail[0], 2), []).append(r.binary(node.detail[0]).select("src", "dst").join(at, near).select("src", "dst", "w"))
            case "plugin":
                functor, pattern = node.detail
                try:
                    back, own = ev.plugins[f"{functor}/{len(pattern)}"].back(ev.plugin_message(node), d, pattern)
                except NoAdjoint as e:
                    raise NoAdjoint(f"{e}: {functor}/{len(pattern)}") from None
                for key, g in own.items():
                    if key in parameters:
                        found.setdefault(key, []).append(g)
                if node.inputs and back is not None and id(node.inputs[0]) in useful:
                    send(node.inputs[0], back)
    out = {}
    for key, parts in found.items():
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        out[key] = df.groupBy(*KEYS[key[1]]).agg(F.sum("w").alias("w"))
    return out


def _reaching(order: list[Node], parameters: set[tuple[str, int]], plugins: dict) -> set[int]:
    """Nodes below which a parameter is used."""
    out: set[int] = set()
    for n in order:
        own = n.kind in ("step", "preimage") and (n.detail[0], 2) in parameters or n.kind == "unary" and (n.detail[0], 1) in parameters
        own = own or n.kind == "plugin" and bool(plugins[f"{n.detail[0]}/{len(n.detail[1])}"].parameters & parameters)
        if own or any(id(i) in out for i in n.inputs):
            out.add(id(n))
    return out
