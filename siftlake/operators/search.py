"""Search: three scopes (line, file, document) by three ways to match (fuzzy, exact, regular expression)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import exprs
from siftlake.functions.query import from_mode
from siftlake.operators.ranking import bm25, fuzzy_score_column
from siftlake.plans.corpus import Index
from siftlake.schemas import PATH_SLOT

LINES_PER_FILE = 20
MAX_LIMIT = 500
KEY = ("source", "file_id")


@dataclass(frozen=True)
class SearchParams:
    """A search request. candidate_cap, if set, keeps so many candidates a source in line order, before scoring."""

    q: str
    mode: str = "fuzzy"
    sources: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    date_from: int | None = None
    date_to: int | None = None
    path_prefix: str | None = None
    case_sensitive: bool = False
    limit: int = 50
    offset: int = 0
    candidate_cap: int | None = None
    prefilter: bool = False
    unicode: bool = True

    def __post_init__(self):
        if self.q is None:
            raise ValueError("q is missing")
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset cannot be negative")
        object.__setattr__(self, "limit", min(self.limit, MAX_LIMIT))

    @classmethod
    def from_request(cls, pairs: list[tuple[str, str]]) -> SearchParams:
        """From the pairs of a query string; source and kind may be repeated."""
        last = dict(pairs)
        if "q" not in last:
            raise ValueError("q is missing")
        number = lambda k: int(last[k]) if last.get(k) else None
        return cls(
            q=last["q"], mode=last.get("mode", "fuzzy"),
            sources=tuple(v for k, v in pairs if k == "source"), kinds=tuple(v for k, v in pairs if k == "kind"),
            date_from=number("date_from"), date_to=number("date_to"), path_prefix=(last.get("path_prefix") or "").strip("/") or None,
            case_sensitive=last.get("case_sensitive", "") in ("1", "true"),
            limit=50 if number("limit") is None else number("limit"), offset=number("offset") or 0,
        )


def file_filter(p: SearchParams) -> Column:
    """Filters on file attributes. All of them reach the scan of a stored index."""
    keep = F.lit(True)
    if p.sources:
        keep &= F.col("source").isin(*p.sources)
    if p.kinds:
        keep &= F.col("kind").isin(*exprs.expand_kinds(p.kinds))
    if p.date_from is not None:
        keep &= F.col("mtime") >= p.date_from
    if p.date_to is not None:
        keep &= F.col("mtime") <= p.date_to
    if p.path_prefix:
        keep &= exprs.under_prefix(F.col("path"), p.path_prefix)
    return keep


def _case(p: SearchParams, column: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(column, F.lit(t)) for t in terms]) if p.case_sensitive and terms else F.lit(True)


def candidates(index: Index, p: SearchParams) -> DataFrame:
    """Unscored hits of line and file scopes, and of doc-exact: rows of lines."""
    scope, match = from_mode(p.mode)
    lines = index.lines.filter(file_filter(p))
    if scope == "file":
        lines = lines.filter(F.col("line_number") == PATH_SLOT)
    if match == "regex":
        literals = exprs.fuzzy_terms(exprs.regex_literals(p.q)) if p.prefilter else []
        target = F.col("path") if scope == "file" else F.col("content")
        found = lines.filter(exprs.contains_all(F.col("content"), literals) & exprs.matches_regex(target, p.q, p.case_sensitive, unicode=p.unicode))
    else:
        terms = exprs.fuzzy_terms(p.q) if match == "fuzzy" else exprs.phrase_terms(p.q)
        if not terms:  # nothing to look for: all files below a given prefix, or nothing
            return lines.filter(F.col("line_number") == PATH_SLOT) if p.path_prefix else lines.filter(F.lit(False))
        found = lines.filter(exprs.contains_all(F.col("content"), terms) & _case(p, F.col("content"), terms))
    if p.candidate_cap is not None:
        turn = F.row_number().over(Window.partitionBy("source").orderBy("file_id", "line_number"))
        found = found.withColumn("turn", turn).filter(F.col("turn") <= p.candidate_cap).drop("turn")
    return found


def document_lines(index: Index, p: SearchParams, per_file: int | None = LINES_PER_FILE, max_files: int | None = None) -> DataFrame:
    """Lines with any token, of files that hold every token somewhere, with rank (BM25 over all tokens, lower is better)
    and turn (their place in the file by rank); hits_truncated tells that a file has more lines than per_file.

    max_files keeps the files whose best lines rank first. Only lines with a token are shuffled, once, by file; which
    tokens a file has, how many lines match and which come first are window functions over that one exchange.
    """
    terms = exprs.document_terms(p.q)
    if not terms:
        return index.lines.filter(F.lit(False)).select("*", F.lit(0.0).alias("rank"), F.lit(1).alias("turn"), F.lit(False).alias("hits_truncated"))
    matching = index.lines.filter(file_filter(p) & exprs.contains_any(F.col("content"), terms))
    ranked = bm25(index.lines, terms, matching)
    whole = Window.partitionBy(*KEY)
    every = reduce(lambda a, b: a & b, [F.max(exprs.contains_term(F.col("content"), t) & _case(p, F.col("content"), [t])).over(whole) for t in terms])
    found = ranked.withColumn("all_terms", every).withColumn("matches", F.count(F.lit(1)).over(whole))
    found = found.withColumn("turn", F.row_number().over(whole.orderBy("rank", "line_number"))).filter("all_terms")
    if max_files is not None:
        first = found.filter("turn = 1").orderBy("rank", *KEY).limit(max_files).select(*KEY)
        found = found.join(first, list(KEY), "left_semi")
    if per_file is not None:
        found = found.filter(F.col("turn") <= per_file)
    more = F.col("matches") > per_file if per_file is not None else F.lit(False)
    return found.withColumn("hits_truncated", more).drop("all_terms", "matches")


def best_lines(index: Index, p: SearchParams) -> DataFrame:
    """The best-ranked line of each file that holds every token; the first p.limit files by the rank of these lines."""
    best = document_lines(index, p, per_file=1).drop("turn", "hits_truncated")
    return best.orderBy("rank", *KEY).limit(p.limit)


def grouped_by_file(hits: DataFrame) -> DataFrame:
    """First hit of each file, with the number of further hits in content or metadata lines."""
    first = F.min(F.struct("line_number", "content")).alias("first")
    later = F.sum((F.col("line_number") > PATH_SLOT).cast("long")).alias("beyond")
    by = hits.groupBy("source", "file_id", "path", "kind", "mtime", "size").agg(first, later)
    extra = F.col("beyond") - (F.col("first.line_number") > PATH_SLOT).cast("long")
    return by.select("source", "file_id", "path", "kind", "mtime", "size", "first.line_number", "first.content", extra.alias("extra_matches"))


def extra_matches(hits: DataFrame) -> DataFrame:
    """The hits that `grouped_by_file` only counts, a row each: all of a file but its first, without its path."""
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy("line_number"))
    return hits.withColumn("turn", turn).filter((F.col("turn") > 1) & (F.col("line_number") > PATH_SLOT)).drop("turn")


def document_regex(index: Index, p: SearchParams) -> DataFrame:
    """Files whose whole text (all slots, joined by line ends) matches; the line is where the first match starts."""
    texts = index.texts.filter(file_filter(p))
    found = texts.filter(exprs.matches_regex(F.col("content"), p.q, p.case_sensitive, dot_all=True, unicode=p.unicode))
    flags = "(?" + ("" if p.case_sensitive else "i") + "s" + ("U" if p.unicode else "") + ")"
    before = F.split(F.col("content"), flags + p.q, 2).getItem(0)
    line = (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("long")
    return found.withColumn("line_number", line).withColumn("content", F.get(F.split("content", "\n"), F.col("line_number").cast("int")))


def search_hits(index: Index, p: SearchParams) -> DataFrame:
    """All hits: source, file_id, path, archive_path, line_number, snippet, score, kind, mtime, size, extra_matches, hits_truncated."""
    scope, match = from_mode(p.mode)
    score, extra, truncated = F.lit(0), F.lit(0).cast("long"), F.lit(False)
    if p.mode == "document":
        hits, truncated = document_lines(index, p), F.col("hits_truncated")
        score = F.coalesce(fuzzy_score_column(F.col("content"), p.q, p.case_sensitive), F.lit(1))
    elif p.mode == "doc-exact":
        hits, extra = grouped_by_file(candidates(index, p)), F.col("extra_matches")
    elif p.mode == "doc-regex":
        hits = document_regex(index, p)
    else:
        hits = candidates(index, p)
        if match == "fuzzy":
            score = fuzzy_score_column(F.col("path"), p.q, p.case_sensitive)
            if scope == "line":
                score = F.coalesce(score, F.lit(1))
    hits = hits.withColumn("score", score.cast("int"))
    if p.mode == "file-fuzzy":
        hits = hits.filter(F.col("score").isNotNull())
    return hits.select(
        "source", "file_id", exprs.outer_path(F.col("path")).alias("path"), exprs.archive_path(F.col("path")).alias("archive_path"),
        "line_number", exprs.strip_path_mark(F.col("content")).alias("snippet"), "score", "kind", "mtime", "size",
        extra.alias("extra_matches"), truncated.alias("hits_truncated"),
    )


def best_per_line(hits: DataFrame) -> DataFrame:
    """One hit for each source, path, archive path and line: that of the highest score."""
    same = Window.partitionBy("source", "path", "archive_path", "line_number").orderBy(F.desc("score"), "file_id")
    return hits.withColumn("turn", F.row_number().over(same)).filter("turn = 1").drop("turn")


def search_page(index: Index, p: SearchParams) -> DataFrame:
    """A page of hits, best score first; the order is total, so pages neither overlap nor leave gaps."""
    ordered = best_per_line(search_hits(index, p)).orderBy(F.desc("score"), "source", "file_id", "line_number")
    return ordered.offset(p.offset).limit(p.limit)


def search_total(index: Index, p: SearchParams) -> DataFrame:
    """total hits, and capped: whether a page of the given limit is full."""
    total = best_per_line(search_hits(index, p)).agg(F.count(F.lit(1)).alias("total"))
    page = F.greatest(F.least(F.col("total") - p.offset, F.lit(p.limit)), F.lit(0))
    return total.withColumn("capped", (page == p.limit) & (page > 0))


def capped_total(index: Index, p: SearchParams, cap: int = 2000) -> DataFrame:
    """total of unscored hits, counted no further than cap: tasks stop when they have so many."""
    return candidates(index, p).limit(cap).agg(F.count(F.lit(1)).alias("total"))


def ranked_lines(index: Index, p: SearchParams) -> DataFrame:
    """The p.limit best lines with all terms by BM25 (lower is better)."""
    terms = exprs.fuzzy_terms(p.q)
    hits = index.lines.filter(file_filter(p) & exprs.contains_all(F.col("content"), terms))
    return bm25(index.lines, terms, hits).orderBy("rank", *KEY, "line_number").limit(p.limit)


def duplicate_groups(files: DataFrame) -> DataFrame:
    """file_hash, files, path (the least): one row for each hash that several files have. Files without a hash have no duplicates."""
    groups = files.filter("file_hash is not null").groupBy("file_hash").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path"))
    return groups.filter("files > 1")


def singletons(files: DataFrame) -> DataFrame:
    """file_hash, path of the hashes that one file has."""
    groups = files.filter("file_hash is not null").groupBy("file_hash").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path"))
    return groups.filter("files = 1").drop("files")


def duplicate_members(files: DataFrame) -> DataFrame:
    """Rows of files that have duplicates, with duplicates: how many others there are. Groups are never gathered."""
    others = duplicate_groups(files).select("file_hash", (F.col("files") - 1).alias("duplicates"))
    return files.join(others, "file_hash")


def with_duplicates(page: DataFrame, files: DataFrame) -> DataFrame:
    """A page of hits (source, file_id) with duplicate_paths: the other paths of the same content, sorted; empty without any.

    Paths are gathered for the hits of the page, which is bounded, and for nothing else.
    """
    own = page.select(*KEY).distinct().join(files.select(*KEY, "file_hash"), list(KEY)).filter("file_hash is not null")
    other = files.select("file_hash", "path", F.col("source").alias("o_source"), F.col("file_id").alias("o_id"))
    pairs = own.join(other, "file_hash").filter((F.col("o_id") != F.col("file_id")) | (F.col("o_source") != F.col("source")))
    found = pairs.groupBy(*KEY).agg(F.sort_array(F.collect_list("path")).alias("duplicate_paths"))
    joined = page.join(found, list(KEY), "left")
    return joined.withColumn("duplicate_paths", F.coalesce("duplicate_paths", F.array().cast("array<string>")))


def merge_page(shown: DataFrame, page: DataFrame) -> DataFrame:
    """Hits shown so far and those of the next page that are new; the next offset advances by the whole page."""
    key = ["source", "path", "archive_path", "line_number"]
    same = [shown[k].eqNullSafe(page[k]) for k in key]
    return shown.unionByName(page.join(shown, reduce(lambda a, b: a & b, same), "left_anti").dropDuplicates(key))


def next_offset(offset: int, page: int, total: int) -> int:
    """Where the next page of a file starts: the lines that the page covered count, not those that it returned."""
    return offset + min(page, total - offset)


def clamp_window(start: int, size: int, total: int) -> int:
    """First line of a window of size lines that stays within total lines."""
    return max(0, min(start, total - size))


def centred_window(line: int, size: int, total: int) -> int:
    """First line of a window with a line in its middle, as far as the ends allow."""
    return clamp_window(line - size // 2, size, total)
