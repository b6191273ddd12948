"""Citations and Markdown: one string for each run, from ordered aggregation.

A run's report is small by nature (dozens of items); runs are many. Every list is sorted by an
explicit position before it is joined. Empty sections are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as f
from ..functions import scrub as sc
from .coverage import drop_overlaps


def ordered(position, value: Column, sep: str = "\n") -> Column:
    """The values of a group joined in the order of position (a column or several)."""
    at = [F.col(c) if isinstance(c, str) else c for c in (position if isinstance(position, (list, tuple)) else [position])]
    rows = F.array_sort(F.collect_list(F.struct(*[a.alias(f"k{i}") for i, a in enumerate(at)], value.alias("v"))))
    return F.array_join(F.transform(rows, lambda x: x["v"]), sep)


def citations(items: DataFrame, run: str = "run") -> DataFrame:
    """(run, url, n, title): distinct URLs of all items' sources, numbered by first appearance over section, item and
    place; title is the host. What is no URL gets no number. items: run, section_no, item_no, sources."""
    rows = items.select(run, "section_no", "item_no", F.posexplode("sources").alias("pos", "url")).where(F.col("url").rlike(rules.WEB_URL))
    first = rows.groupBy(run, "url").agg(F.min(F.struct("section_no", "item_no", "pos")).alias("at"))
    n = F.row_number().over(Window.partitionBy(run).orderBy("at"))
    return first.select(run, "url", n.alias("n"), f.host_of(F.col("url")).alias("title"))


def badges(items: DataFrame, cites: DataFrame, run: str = "run") -> DataFrame:
    """items with badge: " [1][3]", ascending, each number once; empty without numbered sources."""
    rows = items.select(run, "section_no", "item_no", F.explode_outer("sources").alias("url")).join(cites.select(run, "url", "n"), [run, "url"], "left")
    marks = rows.groupBy(run, "section_no", "item_no").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    text = F.concat(F.lit(" "), F.array_join(F.transform("ns", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    return items.join(marks.select(run, "section_no", "item_no", F.when(F.size("ns") > 0, text).otherwise("").alias("badge")), [run, "section_no", "item_no"])


def item_block(title: Column, summary: Column, confidence: Column, status: Column, badge: Column, sourced: Column) -> Column:
    """An item: bold title with its status, summary with badges and marks, confidence."""
    tag = F.when(f.text_of(status) != "", F.concat(F.lit(" `"), status, F.lit("`"))).otherwise("")
    bare = F.when(sourced & (badge == ""), " [no single link]").otherwise("")
    unchecked = F.when(f.is_unchecked(status), " *[unchecked]*").otherwise("")
    sure = F.when(f.text_of(confidence) != "", F.concat(F.lit("\n\n*Confidence: "), f.confidence_label(confidence), F.lit("*"))).otherwise("")
    return F.concat(F.lit("**"), title, F.lit("**"), tag, F.lit("\n\n"), summary, badge, bare, unchecked, sure)


def front_matter(**fields: Column) -> Column:
    """A block of name: value lines; null values are left out, arrays are bracketed."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c)) for name, c in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n---"))


def bracketed(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def card_line(title: Column, url: Column, snippet: Column) -> Column:
    """A card: its title (else its URL, else a placeholder) as a link if the URL is safe, and its snippet as a quote."""
    text = f.escape_markdown(F.coalesce(F.nullif(title, F.lit("")), F.nullif(url, F.lit("")), F.lit("(untitled)")))
    safe = f.safe_url(f.trimmed(f.text_of(url)))
    link = F.when(safe != "", F.concat(F.lit("- ["), text, F.lit("](<"), f.escape_url(safe), F.lit(">)"))).otherwise(F.concat(F.lit("- "), text))
    quote = f.escape_markdown(snippet, multiline=True)
    return F.concat(link, F.when(quote != "", F.concat(F.lit("\n  > "), F.replace(quote, F.lit("\n"), F.lit("\n  > ")))).otherwise(""))


def card_list(cards: DataFrame, by: list[str], runs: DataFrame | None = None, empty: str = "_No sources._") -> DataFrame:
    """(by, markdown): one Markdown list for each run; cards: by, seq, title, url, snippet. Runs of ``runs`` without a
    card have the text ``empty``."""
    lists = cards.groupBy(*by).agg(ordered("seq", card_line(F.col("title"), F.col("url"), F.col("snippet"))).alias("markdown"))
    if runs is None:
        return lists
    return runs.select(*by).distinct().join(lists, by, "left").withColumn("markdown", F.coalesce("markdown", F.lit(empty)))


def table(rows: DataFrame, by: list[str], position: str, columns: dict[str, Column]) -> DataFrame:
    """(by, markdown): a Markdown table for each run, its rows in order of position; columns: heading and cell. Cells are
    escaped; a null one is empty."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[f.escape_cell(c.cast("string")) for c in columns.values()]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    return rows.groupBy(*by).agg(F.concat(F.lit(head), ordered(position, line)).alias("markdown"))


def model_input(cards: DataFrame, by: list[str], most: int = 800) -> DataFrame:
    """The prompt data of each run: scrubbed, clarified and escaped cards, numbered from 1, marked as untrusted."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy("seq"))
    title, snippet = sc.scrub(F.col("title"), 200), sc.clarify(F.col("snippet"), F.col("title"), most)
    block = F.concat(F.lit('<untrusted-source index="'), F.col("n").cast("string"), F.lit('" provider="'), f.escape_xml(f.text_of(F.col("provider")), True), F.lit('">\n'), f.escape_xml(title), F.lit("\n"), f.escape_xml(f.text_of(F.col("url"))), F.lit("\n"), f.escape_xml(snippet), F.lit("\n</untrusted-source>"))
    return cards.withColumn("n", n).groupBy(*by).agg(ordered("n", block).alias("prompt"))


def cited_sources(bodies: DataFrame, sources: DataFrame, run: str = "run", most: int = 30) -> DataFrame:
    """Sources (run, place from 1) whose [N] the run's body cites; all if it cites none in range; at most 30."""
    marks = bodies.select(run, F.explode(F.regexp_extract_all("body", F.lit("\\[([0-9]{1,4})\\]"), F.lit(1))).alias("m")).select(run, F.col("m").cast("int").alias("place")).distinct()
    hit = sources.select(run, "place").join(marks, [run, "place"], "left_semi").withColumn("_hit", F.lit(True))
    any_ = hit.select(run).distinct().withColumn("_any", F.lit(True))
    rows = sources.join(bodies.select(run), run, "left_semi").join(hit, [run, "place"], "left").join(any_, run, "left").where("_hit OR _any IS NULL").drop("_hit", "_any")
    rank = F.row_number().over(Window.partitionBy(run).orderBy("place"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def reference_list(cited: DataFrame, run: str = "run") -> DataFrame:
    line = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] ["), f.escape_markdown(F.col("title")), F.lit("](<"), f.escape_url(F.col("url")), F.lit(">)"))
    return cited.groupBy(run).agg(ordered("place", line).alias("markdown"))


def section(head: str, body: Column) -> Column:
    """A headed part, null if the body is null or empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {head}\n\n"), body))


def joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n\n")


def bullets(values: Column) -> Column:
    """An array of texts as a Markdown list; null or empty gives null."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda v: F.concat(F.lit("- "), f.text_of(v))), "\n"))


def numbered_references(cites: DataFrame, run: str = "run") -> DataFrame:
    return cites.groupBy(run).agg(ordered("n", F.concat(F.lit("- ["), F.col("n").cast("string"), F.lit("] ["), "title", F.lit("](<"), "url", F.lit(">)"))).alias("references"))


def near_misses(misses: DataFrame, named: DataFrame, run: str) -> DataFrame:
    """Misses (run, seq, name, date, note) that no text of ``named`` (run, claim) has already, as a list."""
    left = drop_overlaps(misses, named, run)
    note = F.when(f.text_of(F.col("note")) != "", F.concat(F.lit(": "), F.col("note"))).otherwise("")
    return left.groupBy(run).agg(ordered("seq", F.concat(F.lit("- "), "name", F.lit(" ("), F.coalesce("date", F.lit("undated")), F.lit(")"), note)).alias("near"))


def report(runs: DataFrame, items: DataFrame, coverage: DataFrame, misses: DataFrame, run: str = "run", low: int = 8) -> DataFrame:
    """(run, markdown): banner of the material, flags, summary, sections with badges, caveats, near misses that no
    item's title has, open questions, coverage, references; empty sections are left out.

    runs: run, one_liner, exec_summary, flags, caveats, questions (arrays), confirmed, major_out,
    discovered (counts or null; without all three no banner), and perhaps window, which the flags follow on its line; items: run, section_no, section, item_no, title, summary,
    confidence, status, sources; coverage: run, board, claims, urls, degraded, and perhaps the board's title; misses: run, seq, name, date, note.
    """
    cites = citations(items, run)
    marked = badges(items, cites, run)
    block = item_block(F.col("title"), F.col("summary"), F.col("confidence"), F.col("status"), F.col("badge"), F.size("sources") > 0)
    sections = marked.groupBy(run, "section_no", "section").agg(ordered("item_no", block, "\n\n").alias("body"))
    body = sections.groupBy(run).agg(ordered("section_no", F.concat(F.lit("### "), "section", F.lit("\n\n"), "body"), "\n\n").alias("sections"))
    mark = F.when(F.coalesce("degraded", F.lit(False)), " `[degraded]`").otherwise("")
    cover = coverage.groupBy(run).agg(ordered("board", F.concat(F.lit("- **"), board_title(coverage), F.lit("**: "), F.col("claims").cast("string"), F.lit(" claims / "), F.col("urls").cast("string"), F.lit(" sources"), mark)).alias("coverage"))
    near = near_misses(misses, items.select(run, F.col("title").alias("claim")), run)
    rows = runs
    for part in (body, numbered_references(cites, run), cover, near):
        rows = rows.join(part, run, "left")
    known = F.col("confirmed").isNotNull() | F.col("discovered").isNotNull()
    count = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    banner = F.when(known, F.concat(F.lit("> **Material**: "), count("confirmed"), F.lit(" of the day; "), count("discovered"), F.lit(" sources of late.")))
    scarce = F.coalesce("confirmed", F.lit(0)) + F.coalesce("major_out", F.lit(0)) < low
    thin = F.when((known | F.col("major_out").isNotNull()) & scarce, F.lit(f"> **Low material**: fewer than {low} hard sources; mind their age."))
    flags = window_line(runs)
    text = joined(
        F.concat(F.lit("# Daily report "), F.col(run).cast("string")), banner, thin, flags,
        section("In one line", F.col("one_liner")), section("Summary", F.col("exec_summary")), section("News", F.col("sections")), section("Unverified and limits", bullets(F.col("caveats"))),
        section("Outside the window", F.col("near")), section("Open questions", bullets(F.col("questions"))), section("Coverage", F.col("coverage")), section("References", F.col("references")))
    return rows.select(run, text.alias("markdown"))


def board_title(coverage: DataFrame) -> Column:
    return F.coalesce("title", "board") if "title" in coverage.columns else F.col("board")


def window_line(runs: DataFrame) -> Column:
    """The line with a run's window and flags; null without both."""
    window = F.col("window") if "window" in runs.columns else F.lit(None).cast("string")
    flags = F.when(F.size("flags") > 0, F.concat(F.lit("degraded: `"), F.array_join("flags", "`, `"), F.lit("`")))
    parts = F.filter(F.array(F.concat(F.lit("window "), window), flags), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.concat(F.lit("> "), F.array_join(parts, "; ")))


def degraded_report(claims: DataFrame, coverage: DataFrame, misses: DataFrame, run: str = "run", runs: DataFrame | None = None, quiet_board: str = "labs") -> DataFrame:
    """(run, markdown) without a model: window and flags, the reason, confirmed, major and refuted claims with their number,
    votes and badges, near misses that no major claim has, the coverage matrix with the boards' titles and references; but
    for the confirmed claims and the matrix, empty sections are left out.

    runs: run, window, flags (array), reason (null: none is known), quiet (array of companies without news, noted in the
    row of ``quiet_board``); every one of them has a report. Without ``runs`` those that have claims get one without the first parts.

    claims: run, seq, part (confirmed, major_out, killed), claim, source_url, source_quality, date, vote,
    by_vote (whether votes settled it), errored; coverage: run, board, claims, degraded; misses: run, seq, name, date, note.
    References are numbered by first appearance among confirmed and major claims, then refuted ones.
    """
    own = claims.where(F.col("part").isin("confirmed", "major_out", "killed"))
    items = own.select(run, F.when(F.col("part") == "killed", 1).otherwise(0).alias("section_no"), F.col("seq").alias("item_no"), F.when(F.col("source_url").isNotNull(), F.array("source_url")).otherwise(F.array().cast("array<string>")).alias("sources"))
    cites = citations(items, run)
    marked = own.join(badges(items, cites, run).select(run, F.col("item_no").alias("seq"), F.when(F.col("section_no") == 1, True).otherwise(False).alias("_no"), "badge"), [run, "seq"]).where(F.col("_no") == (F.col("part") == "killed"))
    claim = f.trimmed(F.regexp_replace(f.text_of(F.col("claim")), "\\s+", " "))
    vote = F.concat(F.when(F.col("by_vote"), "`✓").otherwise("`◇"), F.coalesce("vote", F.lit("?")), F.lit("`"))
    errors = F.when(F.col("errored") > 0, F.concat(F.lit(" ("), F.col("errored").cast("string"), F.lit(" votes failed)"))).otherwise("")
    lines = {
        "confirmed": F.concat(F.lit("- "), vote, F.lit(" "), claim, "badge", F.lit(" — *("), F.coalesce("source_quality", F.lit("?")), F.lit(")*"), errors),
        "major_out": F.concat(F.lit("- "), claim, F.lit(" ("), F.coalesce("date", F.lit("?")), F.lit(")")),
        "killed": F.concat(F.lit("- ~~"), claim, F.lit("~~ refuted `"), F.coalesce("vote", F.lit("?")), F.lit("`"), "badge", errors),
    }
    counted = [c for name, line in lines.items() for c in (ordered("seq", F.when(F.col("part") == name, line)).alias(name), F.count_if(F.col("part") == name).alias(f"n_{name}"))]
    lists = marked.groupBy(run).agg(*counted)
    if runs is None:
        rows = lists.withColumns({"_line": F.lit(None).cast("string"), "_why": F.lit(None).cast("string"), "quiet": F.lit(None).cast("array<string>")})
    else:
        reason = F.coalesce(F.nullif(f.trimmed(F.regexp_replace(f.text_of(F.col("reason")), "\\s+", " ")), F.lit("")), F.lit("no complete report was made"))
        why = F.concat(F.lit("Reason: "), reason, F.lit(". What follows is put together from the checked claims, one by one."))
        rows = runs.select(run, window_line(runs).alias("_line"), why.alias("_why"), "quiet").join(lists, run, "left")
    board = coverage.join(rows.select(run, "quiet"), run) if runs is not None else coverage.withColumn("quiet", F.lit(None).cast("array<string>"))
    quiet = F.when((F.col("board") == quiet_board) & (F.size("quiet") > 0), F.concat(F.lit("no news: "), F.array_join("quiet", ", ")))
    note = F.coalesce(quiet, F.when(F.coalesce("degraded", F.lit(False)), "degraded"))
    cover = table(board, [run], "board", {"Board": F.col("board"), "Title": board_title(coverage), "Claims": F.col("claims"), "Note": note}).withColumnRenamed("markdown", "coverage")
    near = near_misses(misses, own.where("part = 'major_out'"), run)
    for part in (cover, near, numbered_references(cites, run)):
        rows = rows.join(part, run, "left")
    number = lambda name: F.coalesce(F.col(f"n_{name}"), F.lit(0)).cast("string")
    headed = lambda head, name, tail: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"## {head} ("), number(name), F.lit(f"{tail})\n\n"), F.col(name)))
    within = F.concat(F.lit("## Within the window ("), number("confirmed"), F.lit(", confirmed by votes)"), F.when(F.coalesce("confirmed", F.lit("")) != "", F.concat(F.lit("\n\n"), "confirmed")).otherwise(""))
    text = joined(
        F.concat(F.lit("# Daily report "), F.col(run).cast("string"), F.lit(" (degraded)")), F.col("_line"), F.col("_why"), within, headed("Outside the window: milestones", "major_out", ", not voted on"),
        headed("Refuted", "killed", ", voted down"), section("Outside the window", F.col("near")), section("Coverage", F.col("coverage")), section("References", F.col("references")))
    return rows.select(run, text.alias("markdown"))


def day_note(cards: DataFrame, by: list[str]) -> DataFrame:
    """One block for each card: heading, link, number of files, embedded thread. cards: seq, title, url, files, post_file."""
    embed = F.when(F.col("post_file").isNotNull(), F.concat(F.lit("\n![["), "post_file", F.lit("]]"))).otherwise("")
    block = F.concat(F.lit("### "), f.escape_markdown(f.text_of(F.col("title"))), F.lit("\n"), f.text_of(F.col("url")), F.when(F.col("files") > 0, F.concat(F.lit("\nfiles: "), F.col("files").cast("string"))).otherwise(""), embed)
    return cards.groupBy(*by).agg(ordered("seq", block, "\n\n").alias("markdown"))
