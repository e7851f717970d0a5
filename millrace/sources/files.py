"""Files as documents: a pluggable parser over binary files, a cache by content, a fallback for what can't be parsed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a parser gives for the bytes of a file: pages of text.
Parser = Callable[[bytes], list[str]]


def plain_text(content: bytes) -> list[str]:
    """The parser used where no other is given: UTF-8 text, pages parted by form feeds. A parser of PDF files has the same shape."""
    return content.decode("utf-8", errors="replace").split("\f")


def parsed_files(spark: SparkSession, path: str, parser: Parser = plain_text, most_pages: int = 3, cache: DataFrame | None = None) -> DataFrame:
    """(path, md5, page, text, status): the first pages of each file.

    Spark lists no empty files. A file that the parser fails on has one row with status 'failed' and its error as text. Files whose MD5 is in the cache
    (a frame of the same columns) aren't parsed again. The page limit is the reader's feature; pass a larger one for whole files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), "content")
    if cache is not None:
        files = files.join(cache.select("md5").distinct(), "md5", "left_anti").select("path", "md5", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path_, md5, content in b.itertuples(index=False):
                try:
                    rows += [(path_, md5, i, t, "ok") for i, t in enumerate(parser(bytes(content))[:most_pages])]
                except Exception as e:  # a file's failure is its row, not the job's
                    rows.append((path_, md5, 0, f"{type(e).__name__}: {e}", "failed"))
            yield pd.DataFrame(rows, columns=["path", "md5", "page", "text", "status"])

    fresh = files.mapInPandas(run, "path string, md5 string, page int, text string, status string")
    return fresh.unionByName(cache) if cache is not None else fresh


def upload_list(files: DataFrame, most: int = 25) -> DataFrame:
    """The files of an upload: PDF ones, one for each (name, size), the first `most` by name, as the reference's form takes them."""
    return files.filter(F.lower("name").endswith(".pdf")).dropDuplicates(["name", "size"]).orderBy("name", "size").limit(most)


def markdown_elements(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, is_header, y): the lines of markdown pages, 20 units apart, ## lines as headers."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "raw")).filter(F.trim("raw") != "")
    return lines.select(key, "pos", F.trim(F.regexp_replace("raw", r"^#+\s*", "")).alias("line"), F.col("raw").startswith("##").alias("is_header"), (F.col("pos") * 20).alias("y"))


# ---------------------------------------------------------------------------------------------- chains of parsers

#: Elements that a layout parser gives for the bytes of a file: (page, x, y, font size, bold, text).
LayoutParser = Callable[[bytes], list[tuple[int, float, float, float, bool, str]]]
#: The text that a recognizer of images gives for each page of a file.
Recognizer = Callable[[bytes], list[str]]

# Characters from which a layout counts as read, a page as readable, a file as not in need of recognition; the floor of font sizes.
READ, READABLE, ENOUGH, FONT_FLOOR = 50, 80, 200, 12.0


def plain_layout(content: bytes) -> list[tuple[int, float, float, float, bool, str]]:
    """The layout parser used where no other is given: the lines of plain text, 20 units apart, in one font."""
    return [(p, 0.0, 20.0 * i, FONT_FLOOR, False, line) for p, page in enumerate(plain_text(content)) for i, line in enumerate(page.split("\n")) if line.strip()]


def recognized(pages: list[str], content: bytes, recognize: Recognizer | None, most_pages: int = 2) -> list[str]:
    """pages with those of under 80 characters replaced by what the recognizer reads, if that is longer; only if the file has under 200
    characters in all, and on its first pages."""
    if recognize is None or sum(len(p.strip()) for p in pages) >= ENOUGH:
        return pages
    seen = recognize(content)[:most_pages]
    pages = pages + [""] * (len(seen) - len(pages))
    return [s if len(p.strip()) < READABLE and len(s.strip()) > len(p.strip()) else p for p, s in zip(pages, seen)] + pages[len(seen) :]


def parsed_chain(spark: SparkSession, path: str, layout: LayoutParser = plain_layout, plain: Parser = plain_text, recognize: Recognizer | None = None, most_pages: int = 3, seconds: float = 30.0) -> DataFrame:
    """(path, md5, status, elements, pages): each file by the first way that gives text. A row is known, and may be ordered, by its path.

    'structured' is the layout, if it holds over 50 characters; 'plain' the plain text, with recognition of images where there is little;
    'failed' is a row without either. Each way has so many seconds, then the next is tried. Elements and pages beyond most_pages
    are left out, the reader's feature.
    """
    from concurrent.futures import ThreadPoolExecutor

    files = spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path_, md5, content in b.itertuples(index=False):
                data, elements, pages, status = bytes(content), [], [], "failed"
                pool = ThreadPoolExecutor(1)

                def within(f, *args, pool=pool):
                    try:
                        return pool.submit(f, *args).result(timeout=seconds)
                    except Exception:  # a way that fails or takes too long gives nothing; the next is tried
                        return []

                elements = [e for e in within(layout, data) if e[0] < most_pages]
                if sum(len(e[5]) for e in elements) > READ:
                    status = "structured"
                else:
                    elements = []
                    pages = within(lambda d: recognized(plain(d)[:most_pages], d, recognize), data) or within(lambda d: plain(d)[:most_pages], data)
                    status = "plain" if any(p.strip() for p in pages) else "failed"
                pool.shutdown(wait=False)
                rows.append((path_, md5, status, [{"page": p, "x": x, "y": y, "font": max(FONT_FLOOR, f), "bold": bold, "text": t} for p, x, y, f, bold, t in elements], pages if status == "plain" else []))
            yield pd.DataFrame(rows, columns=["path", "md5", "status", "elements", "pages"])

    return files.mapInPandas(run, "path string, md5 string, status string, elements array<struct<page:int,x:double,y:double,font:double,bold:boolean,text:string>>, pages array<string>")


def structured_sections(parsed: DataFrame) -> DataFrame:
    """(path, ord, header, label, items) of parsed_chain's rows: a layout by the print of its lines, plain pages as one section 'Resume Content'
    that is looked through for headers in its text; a failed file has none. Each file is a row, so that nothing is shuffled."""
    from ..operators import sections as S

    def places(elements) -> list:
        pages: dict[int, list] = {}
        for e in elements:
            pages.setdefault(e["page"], []).append(e)
        margin = {p: min(e["x"] for e in es) for p, es in pages.items()}
        median = {p: sorted(e["font"] for e in es)[len(es) // 2] for p, es in pages.items()}
        above = [None, *[e["y"] for e in elements[:-1]]]
        return [S.Place(e["font"], bool(e["bold"]), e["x"], e["y"], a, margin[e["page"]], median[e["page"]]) for e, a in zip(elements, above)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, elements, pages in b.itertuples(index=False):
                elements = list(elements)
                found = S.checked(S.detected([e["text"] for e in elements], places(elements))) if len(elements) else S.document_sections("\n".join(pages))
                rows += [(path, i, s.header, s.label or S.label_of(s.header, s.content), s.content) for i, s in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "ord", "header", "label", "items"])

    return parsed.select("path", "elements", "pages").mapInPandas(run, "path string, ord int, header string, label string, items array<string>")


def single_section(parsed: DataFrame) -> DataFrame:
    """(path, header, items, n_lines): each file's text as the one section 'Resume Content', its lines the items; what stands in where nothing is told apart."""
    text = F.when(F.size("elements") > 0, F.transform("elements", lambda e: e["text"])).otherwise(F.flatten(F.transform("pages", lambda p: F.split(p, "\n"))))
    items = F.filter(F.transform(text, F.trim), lambda x: x != "")
    return parsed.select("path", F.lit("Resume Content").alias("header"), items.alias("items"), F.size(items).alias("n_lines"))


# ---------------------------------------------------------------------------------------------- requirements and taxonomies


def requirement_text(spark: SparkSession, given: str) -> DataFrame:
    """(text): a requirement given as a file or folder, read whole, or as the text itself."""
    looks_like_path = "\n" not in given and ("/" in given or given.endswith((".txt", ".md"))) and len(given) < 4096
    if looks_like_path:
        try:
            return spark.read.text(given, wholetext=True).select(F.col("value").alias("text"))
        except Exception:  # no such path: it is a text
            pass
    return spark.createDataFrame([(given,)], "text string")


#: The fields of a criteria form, and those of them that are lists.
FORM = ("position_title", "experience_min_years", "education_requirements", "must_have_skills", "nice_to_have_skills", "industry_experience", "responsibilities", "keywords", "location", "seniority_level", "certifications", "languages")
FORM_LISTS = ("must_have_skills", "nice_to_have_skills", "industry_experience", "responsibilities", "keywords", "certifications", "languages")


def form(spark: SparkSession, fields: dict[str, object]) -> DataFrame:
    """One row of a posted criteria form: texts trimmed, years as a number, lists split (responsibilities at line ends first), what isn't given empty."""
    from ..operators import criteria as C

    raw = spark.createDataFrame([tuple(None if fields.get(k) is None else str(fields[k]) if not isinstance(fields[k], list) else "\n".join(map(str, fields[k])) for k in FORM)], ", ".join(f"{k} string" for k in FORM))
    text = lambda k: F.trim(F.coalesce(k, F.lit("")))
    out = {k: C.list_of(F.coalesce(k, F.lit("")), k == "responsibilities" or isinstance(fields.get(k), list)) if k in FORM_LISTS else C.safe_int(F.col(k)) if k == "experience_min_years" else text(k) for k in FORM}
    return raw.select(*[c.alias(k) for k, c in out.items()])


def assembled_taxonomy(core: DataFrame, domains: DataFrame, enabled: list[str]) -> DataFrame:
    """(canonical, surface, domain): the core's forms (canonical, surface), and those of the enabled domains (domain, canonical, surface) on top, in the order
    they are enabled: of a canonical name the last domain's forms hold."""
    from pyspark.sql import Window

    place = F.create_map(*[F.lit(x) for i, d in enumerate(enabled) for x in (d, i + 1)]) if enabled else F.create_map().cast("map<string,int>")
    ranked = core.select("canonical", "surface", F.lit("core").alias("domain"), F.lit(0).alias("_o")).unionByName(domains.select("canonical", "surface", "domain", place[F.col("domain")].alias("_o")).filter("_o IS NOT NULL"))
    last = F.max("_o").over(Window.partitionBy("canonical"))
    return ranked.withColumn("_last", last).filter("_o = _last").drop("_o", "_last")


def domain_config(spark: SparkSession, path: str, default: dict) -> dict:
    """A configuration of one JSON object, laid over the default; the default where the file is missing or can't be parsed."""
    import json

    try:
        text = spark.read.text(path, wholetext=True).limit(1).collect()
        given = json.loads(text[0][0]) if text else {}
    except Exception:  # missing or broken: never fatal
        given = {}
    over = lambda a, b: {**a, **{k: over(a[k], v) if isinstance(a.get(k), dict) and isinstance(v, dict) else v for k, v in b.items()}}
    return over(default, given if isinstance(given, dict) else {})
