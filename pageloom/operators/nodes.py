"""Pages to node rows, and set-wise work on subtrees.

Node ids are preorder numbers, so the subtree of a node is the id range
``node_id .. end_id``. Ranges of two nodes are nested or apart, never crossing. So "lies
below one of these nodes" is a running maximum of ``end_id``, and "sum over a subtree" is a
difference of two running sums: windows over one page, no join of nodes with nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..schemas import NODE
from . import html_tree, selection

# Ship the parser inside the function, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(html_tree)
cloudpickle.register_pickle_by_value(selection)

# Fixed value: bytes of html that are parsed at once, as their nodes are Python objects until they are an Arrow array.
SLICE_BYTES = 500_000

_ARROW = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(),
          pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int32()),
          pa.map_(pa.string(), pa.string())]


def _nodes_function(wanted: frozenset[str], path_tags: frozenset[str], selecting: bool = False):
    """An Arrow function from html to the node array and the reason why there is none; fields not wanted stay null.

    When ``selecting`` it takes, besides, a list of rules (each a list of alternatives) and gives the ids each selects.
    """
    names, types, parse = NODE.fieldNames(), _ARROW, html_tree.parse_or_reason
    seen = [names.index(c) for c in ("parent_id", "tag", "cls", "id_attr", "attrs")]
    kind, any_of, limit = names.index("kind"), selection.select_any, SLICE_BYTES

    def slices(pages: pa.Array) -> Iterator[tuple[int, int]]:
        """Start and length of slices of about ``limit`` bytes; a longer page is a slice of its own, and no page an empty one."""
        start = total = 0
        for i, size in enumerate(pc.binary_length(pages).fill_null(0).to_pylist()):
            if total and total + size > limit:
                yield start, i - start
                start, total = i, 0
            total += size
        yield start, len(pages) - start

    def convert(pages: pa.Array, rules: pa.Array | None) -> pa.Array:
        offsets, columns, chosen, reasons = [0], [[] for _ in names], [], []
        for k, html in enumerate(pages.to_pylist()):
            rows, reason = parse(html or "", path_tags, "raw" in wanted)
            own = list(zip(*rows)) or [()] * len(names)
            if rules is not None:
                look = [own[c] for c in seen]
                look[1] = [t if e == "e" else None for t, e in zip(own[seen[1]], own[kind])]
                chosen.append([any_of(alternatives, *look) for alternatives in rules[k].as_py() or ()])
            for column, values in zip(columns, own):
                column.extend(values)
            offsets.append(offsets[-1] + len(rows))
            reasons.append(reason)
        arrays = [pa.array(c, t) if n in wanted else pa.nulls(offsets[-1], t) for n, t, c in zip(names, types, columns)]
        nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
            arrays, fields=[pa.field(n, t) for n, t in zip(names, types)]))
        found = pa.array(chosen if rules is not None else [None] * len(pages), pa.list_(pa.list_(pa.int32())))
        return pa.StructArray.from_arrays([nodes, found, pa.array(reasons, pa.string())], ["nodes", "found", "reason"])

    parsed = T.StructType([T.StructField("nodes", T.ArrayType(NODE)), T.StructField("found", T.ArrayType(T.ArrayType(T.IntegerType()))),
                           T.StructField("reason", T.StringType())])
    if selecting:
        @F.arrow_udf(parsed)
        def to_nodes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for pages, rules in batches:
                for part in slices(pages):
                    yield convert(pages.slice(*part), rules.slice(*part))
    else:
        @F.arrow_udf(parsed)
        def to_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for pages in batches:
                for part in slices(pages):
                    yield convert(pages.slice(*part), None)
    return to_nodes


# Fixed value: pages of one task, where nodes are rows. Every window over them sorts the task's nodes, so its memory goes by this.
PAGES_PER_TASK = 1000


def page_tasks(pages: DataFrame) -> int | None:
    """Tasks for the nodes of so many pages, which are counted; none is stated for a stream."""
    if pages.isStreaming:
        return None
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-pages.count() // PAGES_PER_TASK))


CORE = ("node_id", "parent_id", "grand_id", "end_id", "kind", "tag", "cls", "id_attr", "in_link", "text")


def with_nodes(pages: DataFrame, html: str = "html", extra: tuple[str, ...] = (),
               path_tags: tuple[str, ...] = (), rules: Column | None = None) -> DataFrame:
    """One row per page with a ``nodes`` array; the page stays where it is, no shuffle.

    With ``path`` among the extra fields, it lists the enclosing elements of these tags only. ``rules``, a list
    of alternatives of steps for each rule, adds ``found``: the node ids that each rule selects.
    """
    function = _nodes_function(frozenset(CORE + tuple(extra)), frozenset(path_tags), rules is not None)
    out = pages.withColumn("_page", function(F.col(html)) if rules is None else function(F.col(html), rules))
    given = {"nodes": F.col("_page.nodes")} | ({} if rules is None else {"found": F.col("_page.found")})
    return out.withColumns(given).drop("_page")


def parsed_once(pages: DataFrame, html: str = "html", rules: str = "rules", path_tags: tuple[str, ...] = ()) -> DataFrame:
    """All that later steps read of a page: the node array with all fields, ``found`` by its ``rules``, and ``parse_error``.

    Steps that are given a frame with ``nodes`` don't parse; the caller stores this one.
    """
    function = _nodes_function(frozenset(NODE.fieldNames()), frozenset(path_tags), True)
    alternatives = F.transform(rules, lambda r: r["alts"])
    return pages.withColumn("_page", function(F.col(html), alternatives)).withColumns(
        {"nodes": F.col("_page.nodes"), "found": F.col("_page.found"), "parse_error": F.col("_page.reason")}).drop("_page", html)


def node_rows(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html",
              extra: tuple[str, ...] = (), per_page: dict[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """One row per node, hash-partitioned by the page key into ``tasks``, else as many as the number of pages asks for.

    Pages with a ``nodes`` array are not parsed again. ``per_page`` holds columns computed from a page's ``nodes`` array and repeated on its rows.

    The single shuffle moves one row per page, its nodes as an array. Explode keeps the
    partitioning, so every later window over a page runs without another shuffle.
    """
    per_page = per_page or {}
    fields = [n for n in NODE.fieldNames() if n in CORE + tuple(extra)]
    # explode_outer: with explode, Catalyst adds a filter that parses every page once more
    parsed = pages if "nodes" in pages.columns else with_nodes(pages.select(*keys, html), html, extra)
    # a stated number, as adaptive execution goes by the size of the arrays, which are far smaller than their rows
    tasks = tasks or page_tasks(pages)
    return (parsed.select(*keys, "nodes")
            .repartition(*([tasks] if tasks else []), *keys)
            .withColumns(per_page)
            .select(*keys, *per_page, F.explode_outer("nodes").alias("n"))
            .filter("n is not null")
            .select(*keys, *per_page, *[F.col(f"n.{f}").alias(f) for f in fields]))


def _page_window(keys: tuple[str, ...]) -> Window:
    return Window.partitionBy(*keys).orderBy("node_id")


def below(keys: tuple[str, ...], chosen: Column) -> Column:
    """True for rows inside the subtree of a chosen row, the row itself included."""
    w = _page_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(chosen, F.col("end_id"))).over(w)
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def drop_subtrees(nodes: DataFrame, keys: tuple[str, ...], chosen: Column) -> DataFrame:
    """Remove the chosen rows with all they contain."""
    return nodes.withColumn("_cut", below(keys, chosen)).filter("not _cut").drop("_cut")


def keep_subtrees(nodes: DataFrame, keys: tuple[str, ...], chosen: Column) -> DataFrame:
    return nodes.withColumn("_in", below(keys, chosen)).filter("_in").drop("_in")


def subtree_measures(nodes: DataFrame, keys: tuple[str, ...], sums: dict[str, Column],
                     peaks: dict[str, Column] | None = None) -> DataFrame:
    """Add, per node, sums of values over the rows below it.

    Every element is visited twice, on entering and on leaving. Running sums over that tour
    differ, between the two visits, by just what lies inside. ``peaks`` are running maxima,
    reported as they stand on leaving. Cost is linear in the nodes, however deep the page.
    """
    peaks = peaks or {}
    visits = F.expr("""if(kind = 'e',
        array(struct(node_id AS at, 0 AS leave), struct(end_id AS at, 1 AS leave)),
        array(struct(node_id AS at, 0 AS leave)))""")
    tour = (nodes
            .withColumns({f"_v_{k}": v for k, v in sums.items()})
            .withColumns({f"_p_{k}": v for k, v in peaks.items()})
            .withColumn("_visit", F.explode(visits)))
    run = (Window.partitionBy(*keys).orderBy("_visit.at", "_visit.leave", F.desc("node_id"))
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tour = tour.withColumns(
        {f"_v_{k}": F.sum(F.expr(f"if(_visit.leave = 0, coalesce(_v_{k}, 0), 0)")).over(run) for k in sums}
        | {f"_p_{k}": F.max(F.expr(f"if(_visit.leave = 0, _p_{k}, NULL)")).over(run) for k in peaks})
    visit = Window.partitionBy(*keys, "node_id")
    out = tour.withColumns(
        {k: (F.max(f"_v_{k}").over(visit) - F.min(f"_v_{k}").over(visit)) for k in sums}
        | {k: F.max(f"_p_{k}").over(visit) for k in peaks})
    return (out.filter("_visit.leave = 0")
            .drop("_visit", *[f"_v_{k}" for k in sums], *[f"_p_{k}" for k in peaks]))


def text_length() -> Column:
    return F.expr("if(kind = 't', length(text), 0)")


def link_text_length() -> Column:
    return F.expr("if(kind = 't' AND in_link, length(text), 0)")


def link_density(text_len: Column, link_len: Column, in_link: Column) -> Column:
    """Share of a node's text that lies in links below it; null for a node without text."""
    return F.try_divide(F.when(in_link, 0).otherwise(link_len), text_len)
