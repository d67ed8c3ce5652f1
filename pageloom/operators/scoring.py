"""Main-text extraction by paragraph scoring, as windows over the nodes of a page.

All windows share the partitioning laid down by ``node_rows``; there is one shuffle in the
whole plan. ``keys`` is the page key plus the pass number: pass 2 keeps unlikely nodes and is
made only for pages that have some, since otherwise both passes are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import article_text_clean, escape_markup, strip_ws
from ..functions.weights import BLOCK_PREFIX, class_weight, is_unlikely, tag_points
from ..session import stored, stored_by
from .html_tree import BLOCKS
from .nodes import (_page_window, drop_subtrees, keep_subtrees, link_density, link_text_length,
                    node_rows, page_tasks, subtree_measures, text_length)

# Subtrees that never hold text of the article.
NO_TEXT_TAGS = ("script", "style", "like")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
EMBEDDED = ("form", "object", "iframe", "embed")
COUNTED = ("p", "img", "li", "a", "embed", "input")
TESTED = ("p", "img", "li", "input")    # links count by their text, embeds are gone by then

COMMAS = "if(kind = 't', length(text) - length(replace(text, ',', '')), 0)"

# Limits of the sibling and clean-up rules.
LEAST_SIBLING_SCORE = 10
SIBLING_SHARE = 0.2
SIBLING_LENGTH = 80
SIBLING_DENSITY = 0.25
HEADING_DENSITY = 0.33


def _is(*tags: str) -> Column:
    return F.expr("kind = 'e' AND tag IN ({})".format(", ".join(f"'{t}'" for t in tags)))


def _before(keys: tuple[str, ...]) -> Window:
    return _page_window(keys).rowsBetween(Window.unboundedPreceding, -1)


def _unlikely(n: Column) -> Column:
    return (n["kind"] == "e") & is_unlikely(n["tag"], n["cls"], n["id_attr"])


def node_passes(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html", only: int | None = None,
                tasks: int | None = None) -> DataFrame:
    """Node rows with ``pass_no`` 1, and 2 where a retry could differ; or of one pass ``only``.

    Class and id are read here, once, into ``weight`` and ``unlikely``, and not carried further.
    """
    passes = F.when(F.exists("nodes", _unlikely), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = node_rows(pages, keys, html, per_page={"passes": passes if only is None else F.array(F.lit(only))}, tasks=tasks)
    return (rows.withColumns({"weight": class_weight("cls", "id_attr"),
                              "unlikely": is_unlikely("tag", "cls", "id_attr")})
            .drop("cls", "id_attr")
            # explode_outer: see node_rows
            .withColumn("pass_no", F.explode_outer("passes")).drop("passes"))


def drop_unlikely(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Remove script, style and like; in pass 1 unlikely nodes too."""
    unlikely = (F.col("kind") == "e") & F.col("unlikely") & (F.col("pass_no") == 1)
    return drop_subtrees(nodes, keys, _is(*NO_TEXT_TAGS) | unlikely).drop("unlikely")


def measured(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Text measures per node, and divs without block content renamed to ``p``.

    Offsets count characters of the page text. They tell where in the page the last character
    that is not a comma stands, which gives the trailing commas of any subtree.
    """
    block = f"kind = 'e' AND tag RLIKE '{BLOCK_PREFIX}' OR kind = 'c' AND tag = '{BLOCKS}'"
    nodes = (nodes
             .withColumns({
                 "begin": F.coalesce(F.sum(text_length()).over(_before(keys)), F.lit(0)),
                 "_prev": F.last(F.expr("if(kind = 't', right(text, 1), NULL)"), ignorenulls=True)
                 .over(_before(keys)),
                 "_bare": F.expr("length(rtrim(',', text))")}))
    out = subtree_measures(
        nodes, keys,
        sums={
            "text_len": text_length(),
            "link_len": link_text_length(),
            "commas": F.expr(COMMAS),
            "blocks": F.expr(f"if({block}, 1, 0)"),
            "dots": F.expr(r"if(kind = 't' AND text RLIKE '[.][ \n]', 1, 0)"),
        },
        peaks={
            "last_plain": F.expr("if(kind = 't' AND _bare > 0, begin + _bare, NULL)"),
            "dot_join": F.expr(r"if(kind = 't' AND text RLIKE '^[ \n]' AND _prev = '.', begin, NULL)"),
            "dot_end": F.expr("if(kind = 't' AND text LIKE '%.', begin + length(text), NULL)"),
        })
    return out.select(
        *[c for c in nodes.columns if c not in ("_prev", "_bare", "tag")],
        F.expr("if(tag = 'div' AND blocks = 0, 'p', tag) AS tag"), "text_len", "link_len", "commas",
        F.expr("""if(coalesce(last_plain, 0) <= begin, 0,
                     commas - (begin + text_len - last_plain) + 1) AS fields"""),
        link_density(F.col("text_len"), F.col("link_len"), F.col("in_link")).alias("density"),
        F.expr("""dots > 0 OR coalesce(dot_join > begin, false)
                  OR (coalesce(dot_end = begin + text_len, false) AND text_len > 0) AS sentence"""))


def scored(nodes: DataFrame, keys: tuple[str, ...], min_text: int = 25) -> DataFrame:
    """Add ``score`` to candidates: parents and grandparents of long enough paragraphs."""
    counts = f"kind = 'e' AND tag IN ('p', 'td') AND text_len >= {int(min_text)}"
    points = "CAST(1 + fields + least(floor(text_len / 100), 3) AS DOUBLE)"
    gifts = F.expr(f"""if({counts},
        array(struct(node_id AS target, CAST(NULL AS DOUBLE) AS amount), struct(parent_id AS target, {points} AS amount),
              struct(grand_id AS target, {points} / 2 AS amount)),
        array(struct(node_id AS target, CAST(NULL AS DOUBLE) AS amount)))""")
    receiver = Window.partitionBy(*keys, "_gift.target")
    base = F.col("weight") + tag_points("tag")
    return (nodes.withColumn("_gift", F.explode(gifts))
            .withColumn("_sum", F.sum("_gift.amount").over(receiver))
            .filter("_gift.amount is null")
            .withColumn("score", (base + F.col("_sum")) * (1 - F.col("density")))
            .drop("_gift", "_sum"))


def with_best(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Repeat the best candidate on all rows of its page; body with score 0 if there is none."""
    page = Window.partitionBy(*keys)

    def entry(score: Column) -> Column:
        return F.struct(score.alias("score"), (-F.col("node_id")).alias("_order"), "node_id", "parent_id")
    best = F.max(F.when(F.col("score").isNotNull(), entry(F.col("score")))).over(page)
    body = F.max(F.when(_is("body"), entry(F.lit(0.0)))).over(page)
    return nodes.withColumn("best", F.coalesce(best, body))


def top_candidates(nodes: DataFrame, keys: tuple[str, ...], n: int = 5) -> DataFrame:
    """The ``n`` best candidates per page."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "node_id")
    return (nodes.filter("score is not null").withColumn("place", F.row_number().over(w))
            .filter(F.col("place") <= n).select(*keys, "place", "node_id", "tag", "score"))


def article_rows(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The best candidate and those of its siblings that belong to the article."""
    taken = F.expr(f"""kind = 'e' AND parent_id = best.parent_id AND (
        node_id = best.node_id
        OR score >= greatest(CAST({LEAST_SIBLING_SCORE} AS DOUBLE), best.score * {SIBLING_SHARE}D)
        OR (tag = 'p' AND ((text_len > {SIBLING_LENGTH} AND density < {SIBLING_DENSITY}D)
                           OR (text_len < {SIBLING_LENGTH} AND density = 0 AND sentence))))""")
    return (keep_subtrees(nodes.withColumn("_taken", F.coalesce(taken, F.lit(False))), keys, F.col("_taken"))
            .withColumn("tag", F.expr("if(_taken AND tag NOT IN ('div', 'p'), 'div', tag)"))
            .select(*keys, "node_id", "end_id", "kind", "tag", "in_link", "text", "weight", "density", "score"))


def sanitized(article: DataFrame, keys: tuple[str, ...], min_text: int = 25) -> DataFrame:
    """Mark what stays after clean-up in ``kept``; each phase is one pass over the rows."""
    bad_heading = _is(*HEADINGS) & F.expr(f"weight < 0 OR coalesce(density > {HEADING_DENSITY}D, false)")
    rows = drop_subtrees(article, keys, bad_heading | _is(*EMBEDDED))

    has_text = r"kind = 't' AND text RLIKE '\\S'"
    backwards = (Window.partitionBy(*keys).orderBy(F.desc("node_id"))
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_next", F.min(F.expr(f"if({has_text}, node_id, NULL)")).over(backwards))
    empty = F.expr("kind = 'e' AND tag = 'p' AND coalesce(_next > end_id, true)")
    rows = drop_subtrees(rows, keys, empty).drop("_next", "density")

    lead = r"length(text) - length(regexp_replace(text, '^\\s+', ''))"
    rows = (rows.withColumn("begin", F.coalesce(F.sum(text_length()).over(_before(keys)), F.lit(0)))
            .withColumn("_first", F.min(F.expr(f"if({has_text}, begin + {lead}, NULL)")).over(backwards)))
    rows = subtree_measures(
        rows, keys,
        sums={"text_len": text_length(), "link_len": link_text_length(), "commas": F.expr(COMMAS)}
        | {f"n_{t}": F.expr(f"if(kind = 'e' AND tag = '{t}', 1, 0)") for t in TESTED},
        peaks={"_last": F.expr(rf"if({has_text}, begin + length(regexp_replace(text, '\\s+$', '')), NULL)")})
    rows = rows.withColumns({
        "length": F.expr("greatest(coalesce(_last - _first, 0), 0)"),
        "density": F.coalesce(link_density(F.col("text_len"), F.col("link_len"), F.col("in_link")), F.lit(0.0))})
    drop = F.expr(f"""kind = 'e' AND tag IN ('table', 'ul', 'div') AND (
        weight + coalesce(score, 0D) < 0
        OR (commas < 10 AND (
            n_img > n_p
            OR (n_li - 100 > n_p AND tag NOT IN ('ul', 'ol'))
            OR n_input > floor(n_p / 3)
            OR (length < {int(min_text)} AND (n_img = 0 OR n_img > 2))
            OR (weight < 25 AND density > 0.2D)
            OR (weight >= 25 AND density > 0.5D))))""")
    w = _page_window(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("_drop"), F.col("end_id"))).over(w)
    return (rows.withColumn("_drop", drop)
            .withColumn("kept", ~F.coalesce(reach >= F.col("node_id"), F.lit(False)))
            .select(*keys, "node_id", "kind", "tag", "text", "kept"))


def assembled(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Kept text of a page, in document order."""
    pieces = F.collect_list(F.when(F.col("kept") & (F.col("kind") == "t"), F.struct("node_id", "text")))
    ordered = F.transform(F.sort_array("_pieces"), lambda x: x["text"])
    return (rows.groupBy(*keys).agg(pieces.alias("_pieces"))
            .select(*keys, F.array_join(ordered, "").alias("plain")))


def _text_of(nodes: DataFrame, k: tuple[str, ...], min_text: int) -> DataFrame:
    rows = scored(measured(drop_unlikely(nodes, k), k), k, min_text)
    return assembled(sanitized(article_rows(with_best(rows, k), k), k, min_text), k)


def main_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html: str = "html",
              min_text: int = 25, retry_length: int = 250, parts: int | None = None, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Article text per page as ``content``; a short one is tried again with all nodes.

    Pages that are to be parsed go through both passes at once, so that none is parsed twice. Pages that have
    their nodes go through the first; only short ones with unlikely nodes go through the second. Pages that lie in
    ``parts`` buckets of the first key stay there. ``scratch`` gets what is written on the way.
    """
    k = (*keys, "pass_no")
    enough = F.length(strip_ws("plain")) >= retry_length
    if "nodes" in pages.columns:
        tasks = parts or page_tasks(pages)
        first = _text_of(node_passes(pages, keys, html, only=1, tasks=tasks), k, min_text)
        first = stored_by(first, "pass-1", keys[0], parts) if parts else stored(first, "pass-1")
        if scratch is not None:
            scratch.append(first)
        again = pages.join(first.filter(~enough).select(*keys), list(keys), "left_semi").filter(F.exists("nodes", _unlikely))
        second = _text_of(node_passes(again, keys, html, only=2, tasks=tasks), k, min_text).select(*keys, F.col("plain").alias("_again"))
        text = first.join(second, list(keys), "left").withColumn("plain", F.coalesce("_again", "plain"))
    else:
        text = _text_of(node_passes(pages, keys, html), k, min_text)
        chosen = F.coalesce(F.max(F.when((F.col("pass_no") == 1) & enough, F.col("plain"))), F.max_by("plain", "pass_no"))
        text = text.groupBy(*keys).agg(chosen.alias("plain"))
    return text.select(*keys, article_text_clean(escape_markup("plain")).alias("content"))
