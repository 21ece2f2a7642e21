"""Documents as ordered blocks: visible text, headings and sections, token-budget segments, abstracts."""

from __future__ import annotations

import re
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusatlas import contracts
from corpusatlas.operators.grouped import fold_groups
from corpusatlas.sources.writers import table_digest

NUMBER = r"^\s*((?:\d+|[IVX]+)(?:\.\d+)*)[.)]?\s+"


def heading_number(c: Column) -> Column:
    """The leading number of a heading, empty without one."""
    return F.regexp_extract(c, NUMBER, 1)


def heading_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, NUMBER, ""), r"[\s:.]+$", "")))


def heading_level(c: Column) -> Column:
    """Parts of the number; 0 without one."""
    n = heading_number(c)
    return F.when(n == "", 0).otherwise(F.size(F.split(n, r"\.")))


def section_groups(blocks: DataFrame, document: str, order: str, boundary: Column, name: str = "section") -> DataFrame:
    """blocks with a section number from 0: it rises with each boundary; blocks before the first are the opening, 0."""
    w = Window.partitionBy(document).orderBy(order)
    return blocks.withColumn(name, F.coalesce(F.sum(boundary.cast("int")).over(w), F.lit(0)).cast("long"))


def main_heading(kind: Column, text: Column, opening: str = r"^introduction\b") -> Column:
    """Main headings are boundaries: unnumbered or of one-part numbers; decimals stay with their parent."""
    return (kind == "heading") & (heading_level(text) <= 1)


OPENING = "Opening: title, abstract and introduction"


def paper_sections(blocks: DataFrame, document: str, order: str, title: str = "title") -> DataFrame:
    """blocks (document, order, kind, text, level, title) with section (from 0), section_name and structure_flags.

    Headings are SectionHeader blocks other than the title. If any heading of the document has a number, those of one-part
    numbers start a section, else those at the introduction's level or above (without one, at the least level met). An
    appendix always does; abstract and introduction never, nor does anything before the introduction: that is the opening.
    Windows over one document's blocks; texts stay where they are."""
    whole, run = Window.partitionBy(document), Window.partitionBy(document).orderBy(order)
    text = F.trim(F.coalesce("text", F.lit("")))
    heading = (F.col("kind") == "SectionHeader") & (F.lower(text) != F.lower(F.trim(F.coalesce(F.col(title), F.lit("")))))
    x = blocks.withColumns({"__h": F.coalesce(heading, F.lit(False)), "__name": heading_name(text), "__number": heading_number(text)})
    h, name, number = F.col("__h"), F.col("__name"), F.col("__number")
    intro = h & name.rlike(r"^introduction\b")
    x = x.withColumns({
        "__numbered": F.max(h & (number != "")).over(whole),
        "__intro": F.min(F.when(intro, F.struct(order, "level"))).over(whole),
        "__least": F.min(F.when(h & (name != "abstract"), F.col("level"))).over(whole),
        "__seen": F.max(intro).over(run),
    })
    main = F.coalesce(F.col("__intro.level"), F.col("__least"), F.lit(1))
    appendix = name.rlike(r"^(?:appendix|appendices|online appendix|supplement)\b")
    boundary = appendix | F.when(F.col("__numbered"), (number != "") & ~number.contains(".")).otherwise(F.col("level") <= main)
    started = h & F.coalesce(boundary, F.lit(False)) & (name != "abstract") & ~name.rlike(r"^introduction\b") & (F.col("__intro").isNull() | F.col("__seen"))
    x = x.withColumn("__starts", started)
    x = x.withColumns({"section": F.sum(F.col("__starts").cast("long")).over(run), "section_name": F.coalesce(F.last(F.when(F.col("__starts"), text), ignorenulls=True).over(run), F.lit(OPENING))})
    flags = {"introduction_not_detected": F.col("__intro").isNull(), "unnumbered_heading_levels_need_review": ~F.col("__numbered"), "no_section_boundaries_detected": F.max("section").over(whole) == F.min("section").over(whole)}
    x = x.withColumn("structure_flags", F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return x.drop("__h", "__name", "__number", "__numbered", "__intro", "__least", "__seen", "__starts")


def text_reader(omit_math: bool = False):
    """A function from html to its visible text."""
    from html.parser import HTMLParser

    ends = frozenset("p div br li tr table h1 h2 h3 h4 h5 h6 section article header footer ul ol pre blockquote".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip, self.math, self.mark = [], 0, 0, "$"

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            elif tag == "math":
                self.math += 1
                block = dict(attrs).get("display") == "block"
                self.out.append("[FORMULA]" if omit_math else "$$" if block else "$")
                self.mark = "$$" if block else "$"
            elif tag in ("td", "th") and self.out and not self.out[-1].endswith("\n"):
                self.out.append(" | ")
            elif tag in ends:
                self.out.append("\n")

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            elif tag == "math" and self.math:
                self.math -= 1
                if not omit_math:
                    self.out.append(self.mark)
            elif tag in ends:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.skip and not (self.math and omit_math):
                self.out.append(data.replace("\n", " "))

    def read(page: str | None) -> str:
        r = Reader()
        r.feed(page or "")
        r.close()
        return "\n".join(x for x in (" ".join(line.split()) for line in "".join(r.out).split("\n")) if x)

    return read


def visible_text(html: Column, omit_math: bool = False) -> Column:
    """Text of html: formulas as $...$ or $$...$$ (or [FORMULA]), cells of a table row joined by |, a line per block, no
    blank lines."""

    @F.arrow_udf("string")
    def read(pages):
        import pyarrow as pa

        one = text_reader(omit_math)
        pa.default_memory_pool().release_unused()  # of the batches before
        # a page at a time is a Python text, not a batch of them
        return pa.array((one(page.as_py()) for page in pages), pa.string())

    return read(html)


def pack_segments(blocks: DataFrame, document: str, budget: int, by_section: bool = True) -> DataFrame:
    """blocks (document, ord, section, text) in order into segments of at most `budget` white-space tokens. A new section
    closes a segment if by_section; a block that fits one segment is not cut, a longer one is cut where the budget is full
    (white-space tokens end at white space, so that is always a cut between words). Returns (document, segment, ord, start, end, tokens), spans in characters of the block."""
    kinds = dict(blocks.dtypes)

    def run(pdf):
        import pandas as pd

        rows, segment, used, last = [], -1, budget + 1, None
        for r in pdf.sort_values("ord").itertuples(index=False):
            text = r.text or ""
            tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
            at = 0
            while at < len(tokens):
                fresh = segment < 0 or used >= budget or by_section and r.section != last
                room = budget if fresh or at == 0 and len(tokens) > budget - used and len(tokens) <= budget else budget - used
                if fresh or room == budget:
                    segment, used = segment + 1, 0
                take = min(room, len(tokens) - at)
                rows.append((getattr(r, document), segment, r.ord, tokens[at][0], tokens[at + take - 1][1], take))
                used, last, at = used + take, r.section, at + take
        return pd.DataFrame(rows, columns=[document, "segment", "ord", "start", "end", "tokens"])

    return blocks.select(document, "ord", "section", "text").groupBy(document).applyInPandas(run, f"{document} {kinds[document]}, segment int, ord {kinds['ord']}, start int, end int, tokens int")


def span_text(text: Column, spans: Column) -> Column:
    """The source ranges (start, end) of text joined by blank lines; overlapping ranges are an error."""
    ordered = F.array_sort(spans)
    overlap = F.exists(F.transform(ordered, lambda s, i: F.coalesce(F.get(ordered, i + 1)["start"] < s["end"], F.lit(False))), lambda b: b)
    joined = F.array_join(F.transform(ordered, lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), "\n\n")
    return F.when(overlap, F.raise_error(F.lit("overlapping spans"))).otherwise(joined)


#: How abstracts, their parts, their ends and front matter begin, and kinds of blocks that hold none.
MARKER = r"^\s*(?:a\s*b\s*s\s*t\s*r\s*a\s*c\s*t|summary)\b\s*[:.\-–—]?\s*"
STRUCTURED = r"^(?:importance|objective[s]?|design\b|setting\b|participants?\b|data sources\b|study selection\b|eligibility criteria\b|data extraction\b|data synthesis\b|exposures?|main outcomes|results|conclusions?\b|manuscript type\b|research (?:question|issue|findings)|theoretical|academic implications|practitioner)"
BOUNDARY = r"^(?:(?:\d+|[IVX]+)[.\s:–-]+)?(?:introduction|keywords?|key\s+words|jel\b|acknowledg|references|bibliography|article\s+history|received\b|accepted\b|available online|copyright|©|corresponding author|e-?mail\b|author (?:information|affiliations|contributions))"
BOILERPLATE = r"^(?:we (?:thank|are grateful)|the authors (?:thank|acknowledge)|this (?:paper|work|research) (?:was|is) (?:supported|funded)|this (?:article|paper) is (?:brought|distributed)|it is not permitted|if you believe|download date|electronic copy|all rights reserved)"
INLINE_END = r"(?:\n|(?<=[.!?])\s+)(?:key\s*words?\s*:|jel\s+(?:classifications?|codes?)\s*:|©|copyright\b|\d+\.?\s+introduction\b)"
NO_ABSTRACT = ("PageHeader", "PageFooter", "Footnote", "Reference", "Table", "TableOfContents", "Figure", "Picture", "Caption", "Equation")


def extract_abstract(blocks: DataFrame, document: str, least: int = 40, most: int = 1000, front_pages: int = 5) -> DataFrame:
    """(document, abstract, method, review, flags, candidates) of blocks (document, ord, text, and if known kind and page).

    marker: from the first block that begins with abstract or summary; structured: from IMPORTANCE, if objectives and
    conclusions follow; both run to a boundary, boilerplate, a second marker, a header that no structured part begins with,
    or words like keywords within a block. candidate: the first of up to eight blocks of least to most words. missing: none.
    Nothing is cut by length; a length outside 30 to `most` words is flagged. Every abstract is for review."""
    kinds = dict(blocks.dtypes)
    rules = {n: re.compile(p, re.I) for n, p in (("marker", MARKER), ("part", STRUCTURED), ("end", BOUNDARY), ("notice", BOILERPLATE))}
    inline, closing = re.compile(INLINE_END, re.I | re.M), re.compile(r"^conclusions?\b", re.I)

    def read(front: list[tuple[str, str]]):
        texts = [t for t, _ in front]
        marked = [i for i, t in enumerate(texts) if rules["marker"].match(t)]
        opened = next((i for i, t in enumerate(texts) if re.match(r"\s*IMPORTANCE\b", t)), None)
        after = " ".join(texts[opened:]) if opened is not None else ""
        if marked:
            method, first = "marker", marked[0]
        elif re.search(r"\bOBJECTIVES?\b", after) and re.search(r"\bCONCLUSIONS?\b", after):
            method, first = "structured", opened
        else:
            fit = (t for t, kind in front if kind in ("", "Text", "TextInlineMath", "text") and least <= len(t.split()) <= most and not rules["end"].match(t.strip()) and not rules["notice"].match(t.strip()))
            fit = list(islice(fit, 8))
            return (fit[0].strip() if fit else ""), ("candidate" if fit else "missing"), ["abstract_boundary_requires_review"] if fit else ["no_abstract_found"], fit
        held, ended, concluded = [], False, False
        for i in range(first, len(front)):
            text, kind = front[i]
            rest = (text[rules["marker"].match(text).end() :] if i == first and method == "marker" else text).strip()
            if not rest:
                continue
            if i > first and (any(rules[n].match(rest) for n in ("end", "notice", "marker")) or kind == "SectionHeader" and not rules["part"].match(rest) or method == "structured" and concluded):
                ended = True
                break
            stop = inline.search(rest)
            held.append((rest[: stop.start()] if stop else rest).strip())
            if stop:
                ended = True
                break
            concluded = concluded or bool(closing.match(rest)) and len(rest.split()) > 8
        abstract = "\n\n".join(h for h in held if h)
        words = len(abstract.split())
        tests = (("no_confirmed_end_boundary", not (ended or concluded)), ("inspect_abstract_length", not 30 <= words <= most), ("multiple_abstract_markers", len(marked) > 1), ("empty_after_heading", not abstract), ("possible_front_matter_contamination", bool(re.search(r"\b(?:we thank|acknowledg|corresponding author|electronic copy available)\b", abstract, re.I))))
        return abstract, method, [n for n, holds in tests if holds] + ["abstract_boundary_requires_review"], []

    wanted = [c for c in ("kind", "page") if c in kinds]

    def run(key, rows):
        front = []
        for _, _, text, *more in rows:
            known = dict(zip(wanted, more, strict=True))
            kind = known.get("kind") or ""
            if kind not in NO_ABSTRACT and ("page" not in known or known["page"] is not None and known["page"] <= front_pages):
                front.append((text or "", kind))
        found = read(front)
        return [(key, found[0], found[1], found[1] != "missing", ";".join(found[2]), found[3])]

    return fold_groups(blocks.select(document, "ord", "text", *wanted), document, ["ord"], run, f"{document} {kinds[document]}, abstract string, method string, review boolean, flags string, candidates array<string>")


#: Kinds of blocks that are no body text, and headings of reference lists.
EXCLUDED_KINDS = ("PageHeader", "PageFooter", "Reference")
REFERENCE_HEADING = r"(?i)^(?:\d+[.\s]*)?(?:references|bibliography|literature cited)$"


def flatten_pages(trees: DataFrame, key: str, tree: str) -> DataFrame:
    """(key, ord, id, kind, page, section, text, html, include, exclusion_reason): the leaves of JSON page trees {id,
    block_type, children, html, section_hierarchy}, in order.

    Pages count from 1 (`/page/N` of the nearest id above, plus one); a kind is its last dotted part; section lists the
    texts of the headings above by rising level, an id that no heading has as it is. Blocks in or heading a reference list,
    page headers and footers are excluded, and so are blocks without text. A null or empty tree has no blocks."""

    @F.pandas_udf("array<struct<id:string,kind:string,page:int,section:array<string>,text:string,html:string>>")
    def leaves(docs):
        import json

        read = text_reader()

        def one(source):
            out, stack = [], [(json.loads(source), None)] if source else []
            while stack:
                node, page = stack.pop()
                if m := re.search(r"/page/(\d+)", node.get("id") or ""):
                    page = int(m[1]) + 1
                if node.get("children"):
                    stack.extend((child, page) for child in reversed(node["children"]))
                    continue
                levels = node.get("section_hierarchy") or {}
                above = [levels[n] for n in sorted(levels, key=int)]
                out.append({"id": node.get("id"), "kind": (node.get("block_type") or "Unknown").split(".")[-1], "page": page, "section": above, "text": read(node.get("html")), "html": node.get("html") or ""})
            titles = {b["id"]: b["text"] for b in out if b["kind"] == "SectionHeader"}
            return [b | {"section": [titles.get(i, i) for i in b["section"]]} for b in out]

        return docs.map(one)

    x = trees.select(key, F.posexplode(leaves(F.col(tree))).alias("ord", "b")).select(key, "ord", "b.*")
    listed = F.exists("section", lambda t: F.trim(t).rlike(REFERENCE_HEADING)) | (F.col("kind") == "SectionHeader") & F.trim("text").rlike(REFERENCE_HEADING)
    reason = F.when(listed, "reference_section").when(F.col("kind").isin(*EXCLUDED_KINDS), F.col("kind"))
    out = x.withColumn("exclusion_reason", reason).withColumn("include", (F.col("text") != "") & F.col("exclusion_reason").isNull())
    return out.select(key, "ord", "id", "kind", "page", "section", "text", "html", "include", "exclusion_reason")


def document_status(blocks: DataFrame, key: str, order: str = "ord", fallback: Column | None = None) -> DataFrame:
    """(key, title, title_source, quality_flags) of flatten_pages' blocks: the first Title block, else the first h1 of page
    1 without its formulas, else `fallback` (a column that is the same on a document's blocks, such as a file name)."""
    plain = F.regexp_replace(visible_text(F.col("html"), omit_math=True), r"[$ ]+$", "")
    first = lambda c, value: F.min(F.when(c, F.struct(order, value.alias("t")))).getField("t")
    block = first(F.col("kind") == "Title", F.col("text"))
    heading = first((F.col("page") == 1) & (F.col("kind") == "SectionHeader") & F.col("html").contains("<h1>"), F.col("__plain"))
    flags = (("no_usable_text", ~F.max("include")), ("replacement_characters", F.max(F.col("text").contains("\ufffd"))), ("contains_detected_formulas", F.max((F.col("kind") == "Equation") | F.col("html").contains("<math"))))
    x = blocks.withColumns({"__plain": plain, "__name": fallback if fallback is not None else F.lit(None).cast("string")})
    g = x.groupBy(key).agg(F.nullif(block, F.lit("")).alias("a"), F.nullif(heading, F.lit("")).alias("b"), F.max("__name").alias("c"), F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in flags]).alias("quality_flags"))
    source = F.when(F.col("a").isNotNull(), "title_block").when(F.col("b").isNotNull(), "first_page_heading").otherwise("file_name")
    return g.select(key, F.coalesce("a", "b", "c").alias("title"), source.alias("title_source"), "quality_flags")


def prioritised(rows: DataFrame, key: str, value: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """rows with `value` and `origin` from the first source (key, value) that has one that is not empty."""
    out, found, origin = rows, F.lit(None).cast("string"), F.lit("missing")
    for name, df in reversed(sources):
        c = f"__{name}"
        out = out.join(df.select(key, F.nullif(F.col(value), F.lit("")).alias(c)), key, "left")
        found, origin = F.coalesce(F.col(c), found), F.when(F.col(c).isNotNull(), name).otherwise(origin)
    return out.withColumns({value: found, "origin": origin}).drop(*[f"__{n}" for n, _ in sources])


def embedding_blocks(blocks: Column, math: str = "keep") -> Column:
    """The included blocks with text; `omit` also drops equations and rewrites blocks with formulas."""
    kept = F.filter(blocks, lambda b: b["include"] & (F.trim(F.coalesce(b["text"], F.lit(""))) != ""))
    if math != "omit":
        return kept
    plain = F.filter(kept, lambda b: b["type"] != "Equation")
    return F.transform(plain, lambda b: b.withField("text", F.when(F.coalesce(b["html"], F.lit("")).contains("<math"), F.trim(F.regexp_replace(F.regexp_replace(b["html"], "(?s)<math.*?</math>", "[FORMULA]"), "<[^>]+>", " "))).otherwise(b["text"])))


def section_report(segments: DataFrame, document: str) -> DataFrame:
    """(document, segment, first_page, last_page, blocks) of segments with a sources column."""
    pages = F.transform("sources", lambda s: s["page"])
    return segments.select(document, "segment", F.array_min(pages).alias("first_page"), F.array_max(pages).alias("last_page"), F.size("sources").cast("long").alias("blocks"))


def prepare_corpus(documents: DataFrame, key: str, text: str = "text", skip_empty: bool = False) -> tuple[DataFrame, DataFrame]:
    """documents with text, and an audit row (key, status, plan_id) for each document. Documents without text are an error
    unless they may be skipped. The plan's id is a digest of the prepared keys and texts."""
    contracts.unique(documents, key)
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    if not skip_empty:
        contracts.holds(documents, ~empty, "a document without text", key)
    plan = table_digest(documents.filter(~empty).select(key, text))
    audit = documents.select(key, F.when(empty, "skipped_empty").otherwise("prepared").alias("status"), F.lit(plan).alias("plan_id"))
    return documents.filter(~empty), audit


def checked_selection(selected: DataFrame, available: DataFrame, key: str, count: int | None = None) -> DataFrame:
    """selected keys, after checks: none twice, none that is not available, and as many available ones as when the selection
    was made."""
    contracts.unique(selected, key)
    contracts.covered(selected, available, key)
    if count is not None and (found := available.count()) != count:
        raise contracts.ContractError(f"{found} documents are available, {count} were")
    return selected
