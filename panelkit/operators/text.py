"""Document corpora: cleaning, keyword paragraphs, character n-gram TF-IDF and adjacent-period continuity.

Vectors are long rows (document, term, weight), never a matrix; only adjacent documents of an entity meet.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelkit import functions as fn
from panelkit.operators import postings
from panelkit.sources import written

# -- cleaning --------------------------------------------------------------------------------------

#: Elements whose content is no text of the page, and those that make blocks. Fixed values.
SKIPPED = frozenset(("script", "style", "noscript", "nav", "footer", "form"))
BLOCKS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Classes of elements that hold a page's content. Fixed values.
CONTAINERS = "TRS_.*EDITOR|main_inner|article|content|正文|文章|detail"
#: Beginnings of lines that belong to the site and not to its text. Fixed values.
BOILERPLATE = ("责任编辑", "扫一扫", "网站地图", "主办单位", "版权所有", "备案号", "打印", "字体", "分享", "收藏", "关闭", "首页", "当前位置")


class _Page(HTMLParser):
    """Texts of a page in order, and which of them each block and each container spans.

    An element lasts to its end tag or to that of one around it, so spans nest as elements do; a text inside a block inside
    another block belongs to both.
    """

    def __init__(self, containers: re.Pattern, tags: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.containers, self.tags = containers, tags
        self.texts: list[str] = []
        self.open: list[tuple] = []  # tag, first text, number, whether it holds content, whether it is skipped
        self.blocks: list[tuple[int, int, int]] = []  # number, first text, end
        self.held: list[tuple[int, int, int]] = []
        self.seen = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        skipped = tag in SKIPPED or bool(self.open and self.open[-1][4])
        holds = tag in self.tags or bool(self.containers.search(dict(attrs).get("class") or ""))
        self.open.append((tag, len(self.texts), self.seen, holds, skipped))
        self.seen += 1

    def handle_endtag(self, tag: str) -> None:
        if any(e[0] == tag for e in self.open):
            while self._end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if data.strip() and not (self.open and self.open[-1][4]):
            self.texts.append(data.strip())

    def close(self) -> None:
        super().close()
        while self.open:
            self._end()

    def _end(self) -> str:
        tag, first, number, holds, skipped = self.open.pop()
        if not skipped:
            span = (number, first, len(self.texts))
            if tag in BLOCKS:
                self.blocks.append(span)
            if holds:
                self.held.append(span)
        return tag


def normal_lines(text: str, boilerplate: tuple[str, ...] = BOILERPLATE) -> str:
    """NFKC, entities resolved, control characters out, blanks squeezed; empty lines and those that begin with boilerplate left out."""
    t = unicodedata.normalize("NFKC", unescape(text)).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
    lines = [re.sub(r"[ \t\f\v]+", " ", line).strip() for line in t.split("\n")]
    return "\n".join(x for x in lines if x and not x.startswith(boilerplate))


def page_text(markup: str | None, containers: str = CONTAINERS, tags: frozenset[str] = frozenset(), boilerplate: tuple[str, ...] = BOILERPLATE) -> str | None:
    """The readable text of a page: blocks of its longest content container by line.

    Containers are elements with a class that ``containers`` finds, in any case, or one of ``tags``; of equally long ones the first;
    without one, the page. All text of the container if its blocks hold less than half of it, all of the page if it has none.
    """
    if markup is None:
        return None
    p = _Page(re.compile(containers, re.I), tags)
    p.feed(markup)
    p.close()
    number, first, end = max(sorted(p.held), key=lambda c: len(" ".join(p.texts[c[1] : c[2]])), default=(-1, 0, len(p.texts)))
    blocks = [" ".join(p.texts[s:e]) for n, s, e in sorted(p.blocks) if n > number and first <= s and e <= end and s < e]
    chosen = normal_lines("\n\n".join(blocks), boilerplate)
    whole = normal_lines("\n".join(p.texts[first:end]), boilerplate)
    if not blocks or 2 * len(chosen) < len(whole):
        chosen = whole
    return chosen or normal_lines("\n".join(p.texts), boilerplate)


def clean_pages(df: DataFrame, html_col: str, out: str = "text", containers: str = CONTAINERS, tags: tuple[str, ...] = (), boilerplate: tuple[str, ...] = BOILERPLATE) -> DataFrame:
    """``df`` with the readable text of each page, see ``page_text``: an Arrow UDF around the standard library's parser."""

    @F.pandas_udf("string")
    def cleaned(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in pages:
            yield x.map(lambda t: page_text(t, containers, frozenset(tags), boilerplate)).astype(object)

    return df.withColumn(out, cleaned(F.col(html_col)))


def decoded_page(payload: bytes, content_type: str | None = None) -> tuple[str, str, str]:
    """(text, encoding, status): by the charset of the content type, of the page's head, UTF-8 or GB18030, the first that fits; else UTF-8 with replacements and a warning."""
    asked = [re.search(r"charset=([\w-]+)", content_type or "", re.I), re.search(r"charset\s*=\s*[\"']?([\w-]+)", payload[:4096].decode("ascii", "replace"), re.I)]
    for name in dict.fromkeys([*(m.group(1).lower() for m in asked if m), "utf-8", "gb18030"]):
        try:
            return payload.decode(name), name, "ok"
        except (UnicodeDecodeError, LookupError):
            continue
    return payload.decode("utf-8", "replace"), "utf-8", "warning"


def page_corpus(df: DataFrame, payload: str, core: list[str], context: list[str], content_type: str | None = None, containers: str = CONTAINERS, tags: tuple[str, ...] = (), short_full: int = 500, short_kept: int = 80, high_share: float = 0.95) -> DataFrame:
    """``df`` without its bytes, with full_text, kept_text, their lengths and share, hits, encoding, decode_status and quality_flags.

    One pass from the bytes of a page to a row of the corpus: decoded, cleaned, paragraphs with a core term kept, hits counted,
    flags set. Decoding and parsing are one Arrow UDF, the rest built-in functions; nothing is shuffled. A null payload is an empty text.
    """

    @F.pandas_udf("struct<text:string,encoding:string,status:string>")
    def read(payloads: pd.Series, types: pd.Series) -> pd.DataFrame:
        rows = []
        for x, kind in zip(payloads, types, strict=True):
            t, encoding, status = decoded_page(x or b"", kind)
            rows.append((page_text(t, containers, frozenset(tags)), encoding, status))
        return pd.DataFrame(rows, columns=["text", "encoding", "status"], dtype=object)

    kind = F.col(content_type) if content_type else F.lit(None).cast("string")
    rows = df.withColumn("__r", read(F.col(payload), kind)).drop(payload)
    rows = rows.select(*[c for c in rows.columns if c != "__r"], F.col("__r.text").alias("full_text"), F.col("__r.encoding").alias("encoding"), F.col("__r.status").alias("decode_status"))
    out = keyword_paragraphs(rows, "full_text", core, context)
    full, kept = F.length("full_text"), F.length("kept_text")
    out = out.withColumns({"full_chars": full, "kept_chars": kept, "kept_share": F.when(full > 0, kept / full).otherwise(0.0), "hits": F.col("core_hits") + F.col("context_hits")})
    flags = {"empty_text": F.col("full_chars") == 0, "short_text": F.col("full_chars").between(1, short_full - 1), "empty_kept": F.col("kept_chars") == 0, "short_kept": F.col("kept_chars").between(1, short_kept - 1), "high_share": F.col("kept_share") > high_share, "decode_warning": F.col("decode_status") != "ok"}
    return out.withColumn("quality_flags", fn.flag_list(flags))


def clean_pages_by_pattern(df: DataFrame, html_col: str, out: str = "text") -> DataFrame:
    """A JVM-only variant by regular expressions: skipped elements out, tags to blanks, blanks squeezed."""
    x = F.regexp_replace(F.col(html_col), r"(?is)<(script|style|noscript|nav|footer|form)\b.*?</\1\s*>", " ")
    return df.withColumn(out, F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")))


def decoded(df: DataFrame, bytes_col: str, charset_col: str | None = None, out: str = "text") -> DataFrame:
    """``df`` with text from bytes and ``decode_status``: a declared charset, else UTF-8, else GB18030 with replacements."""

    def decode(x: bytes | None, declared: str | None) -> tuple[str | None, str | None]:
        if x is None:
            return None, None
        for name in (declared, "utf-8", "gb18030"):
            try:
                if name:
                    return x.decode(name), "declared" if name == declared else name
            except (UnicodeDecodeError, LookupError):
                continue
        return x.decode("utf-8", "replace"), "replaced"

    @F.pandas_udf("struct<text:string,status:string>")
    def both(x: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(a, b) for a, b in zip(x, c, strict=True)], columns=["text", "status"], dtype=object)

    declared = F.col(charset_col) if charset_col else F.lit(None).cast("string")
    valid = F.is_valid_utf8(F.col(bytes_col).cast("string"))
    slow = df.withColumn("__d", F.when(valid & declared.isNull(), F.struct(F.col(bytes_col).cast("string").alias("text"), F.lit("utf-8").alias("status"))).otherwise(both(F.col(bytes_col), declared)))
    return slow.withColumn(out, F.col("__d.text")).withColumn("decode_status", F.col("__d.status")).drop("__d")


# -- keywords --------------------------------------------------------------------------------------


def _hits(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [fn.occurrences(text, t) for t in terms], F.lit(0).cast("long"))


def keyword_paragraphs(df: DataFrame, text_col: str, core: list[str], context: list[str]) -> DataFrame:
    """``df`` with kept_text (paragraphs with a core term, blank lines between), core_hits and context_hits over all paragraphs, and kept_paragraphs.

    Higher-order functions inside a row: no shuffle.
    """
    ps = fn.paragraphs(F.coalesce(F.col(text_col), F.lit("")))
    out = df.withColumn("__p", F.transform(ps, lambda p: F.struct(p.alias("t"), _hits(p, core).alias("core"), _hits(p, context).alias("context"))))
    kept = F.filter("__p", lambda p: p["core"] > 0)

    def total(f: str) -> Column:
        return F.aggregate("__p", F.lit(0).cast("long"), lambda a, p: a + p[f])

    return out.withColumns({"kept_text": F.array_join(F.transform(kept, lambda p: p["t"]), "\n\n"), "core_hits": total("core"), "context_hits": total("context"), "kept_paragraphs": F.size(kept)}).drop("__p")


def clean_corpus(df: DataFrame, text_col: str, core: list[str], context: list[str], short_full: int = 500, short_kept: int = 80, high_share: float = 0.95) -> DataFrame:
    """Corpus rows: cleaned text, kept paragraphs, lengths, share and quality flags."""
    clean = df.withColumn("full_text_clean", F.array_join(fn.lines(F.coalesce(F.col(text_col), F.lit(""))), "\n"))
    out = keyword_paragraphs(clean, "full_text_clean", core, context)
    full, kept = F.length("full_text_clean"), F.length("kept_text")
    out = out.withColumns({"full_chars": full, "kept_chars": kept, "kept_share": F.when(full > 0, kept / full)})
    flags = {"empty_text": F.col("full_chars") == 0, "short_text": F.col("full_chars").between(1, short_full - 1), "empty_kept": F.col("kept_chars") == 0, "short_kept": F.col("kept_chars").between(1, short_kept - 1), "high_share": F.col("kept_share") > high_share}
    return out.withColumn("quality_flags", fn.flag_list(flags))


def review_code(rules: list[tuple[str, Column]], ok: str = "ok") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(ok)
    for name, c in reversed(rules):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def document_review(text: Column, title: Column, year: Column, place: Column, phrase: str, summary: str = r"(?i)summary", challenge: str = r"(?i)captcha|verify you are human", least: int = 5000) -> Column:
    """empty, summary_title, challenge_page, too_short, phrase_absent, year_absent, place_absent or ok; the first that applies."""
    t = F.coalesce(text, F.lit(""))
    absent = {"phrase_absent": F.lit(phrase), "year_absent": year.cast("string"), "place_absent": place}
    return review_code([("empty", t == ""), ("summary_title", F.coalesce(title.rlike(summary), F.lit(False))), ("challenge_page", t.rlike(challenge)), ("too_short", F.length(t) < least), *[(k, ~F.coalesce(t.contains(v), F.lit(False))) for k, v in absent.items()]])


# -- n-grams and vectors ---------------------------------------------------------------------------


def ngrams(chars: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams of an array of characters, repeats included; linear in its length."""
    def of(n: int) -> Column:
        count = F.size(chars) - n + 1
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def _characters(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and __c, the characters of the normalised text: single UTF-16 units, all of them."""
    t = fn.vector_text(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(*keep, t.alias("__t")).select(*keep, F.split("__t", "").alias("__c")).select(*keep, F.filter("__c", lambda c: c != "").alias("__c"))


def term_counts(df: DataFrame, doc: list[str], text_col: str, low: int = 2, high: int = 4) -> DataFrame:
    """(doc, term, c): n-gram counts of each document's normalised text; combined in tasks before the shuffle."""
    grams = _characters(df, doc, text_col).select(*doc, F.explode(ngrams(F.col("__c"), low, high)).alias("term"))
    return grams.groupBy(*doc, "term").agg(F.count("*").alias("c"))


def _packed_counts(docs: DataFrame, keep: list[str], text_col: str, low: int, high: int) -> DataFrame:
    """(__doc, keep, term, c): as ``term_counts``, with n-grams of up to four characters as one long of 16 bits each.

    Texts are dealt out by document, as a table of few files would have few tasks; n-grams, many times their size, are counted as
    arrays where the text lies and not shuffled. Longer n-grams are counted as texts.
    """
    if high > 4:
        return term_counts(docs, ["__doc", *keep], text_col, low, high)
    cols = ["__doc", *keep]
    dealt = docs.select(*cols, text_col).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("__doc"))
    texts = dealt.select(*cols, fn.vector_text(F.coalesce(F.col(text_col), F.lit(""))).alias("__t"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in enumerate(b["__t"].to_pylist()):
                units = np.frombuffer(t.encode("utf-16-le"), "<u2").astype(np.uint64)
                grams, found = units, [units] if low == 1 else []
                for n in range(2, high + 1):
                    grams = (grams[: max(len(units) - n + 1, 0)] << np.uint64(16)) | units[n - 1 :]
                    found += [grams] if n >= low else []
                term, c = np.unique(np.concatenate(found), return_counts=True)
                one = pa.array(np.full(len(term), row))
                yield pa.RecordBatch.from_arrays([*[b[k].take(one) for k in cols], pa.array(term.view(np.int64)), pa.array(c)], [*cols, "term", "c"])

    schema = StructType([*[texts.schema[k] for k in cols], StructField("term", LongType()), StructField("c", LongType())])
    return texts.mapInArrow(_gathered(counted), schema)


def _gathered(of: Callable, most: int = 1 << 16) -> Callable:
    """``of``, with its many small batches joined to some of about ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in of(batches):
            held.append(b)
            if sum(map(len, held)) >= most:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    return run


def _raw_weight(n: str = "n", df: str = "df") -> Column:
    return (1 + F.ln("c")) * (F.ln((1 + F.col(n)) / (1 + F.col(df))) + 1)


def tfidf(df: DataFrame, doc: list[str], text_col: str, low: int = 2, high: int = 4, min_df: int = 2) -> DataFrame:
    """(doc, term, w): (1 + ln c) * (ln((1 + N) / (1 + df)) + 1) of terms in ``min_df`` documents or more, of length 1.

    A document is a row, so ``doc`` must name one row each; N counts all, empty ones too. Rare terms are dropped
    before the join back, which makes it much smaller; Spark splits the join where a term is hot.
    """
    counts = written(term_counts(df, doc, text_col, low, high))
    n = df.agg(F.count("*").alias("n"))
    dfs = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    w = counts.join(dfs, "term").join(F.broadcast(n))  # one row
    w = w.select(*doc, "term", _raw_weight().alias("w"))
    norm = w.groupBy(*doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, doc).select(*doc, "term", (F.col("w") / F.col("norm")).alias("w"))


def _alone(keys: DataFrame, entity: str, period: str) -> DataFrame:
    """(entity, period, __before): documents that are the only ones of their entity and period."""
    return keys.groupBy(entity, period).agg(F.count("*").alias("__n"), F.min("__doc").alias("__before")).where("__n = 1").drop("__n")


def _with_before(keys: DataFrame, one: DataFrame, entity: str, period: str) -> DataFrame:
    """(__doc, __before) of documents whose entity has exactly one in the period before."""
    return keys.join(one.withColumn(period, F.col(period) + 1), [entity, period]).select("__doc", "__before")


def adjacent(df: DataFrame, entity: str, period: str, text_col: str, ident: str | None = None) -> DataFrame:
    """(entity, period, ident, text_col, __doc, __before, __serves): every row as a document of its own.

    __before is the entity's document of the period before, where that has exactly one; all documents of a period
    may have the same. __serves tells whether the document is one that others have before them. Without ``ident``, a column that
    names a row, rows are written once and numbered.
    """
    names = [entity, period, *([ident] if ident else []), text_col]
    base = df.select(*names)
    base = base.withColumn("__doc", F.col(ident)) if ident else written(base.withColumn("__doc", F.monotonically_increasing_id()))
    keys = base.select(entity, period, "__doc")
    one = _alone(keys, entity, period)
    after = keys.select(entity, (F.col(period) - 1).alias(period)).distinct()
    serves = one.join(after, [entity, period]).select(F.col("__before").alias("__doc"), F.lit(True).alias("__serves"))
    return base.join(_with_before(keys, one, entity, period), "__doc", "left").join(serves, "__doc", "left")


def _scored(docs: DataFrame, dots: DataFrame, now: DataFrame, before: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name) for every document: ``dots`` over the norms of both, 0 without a shared term, null without a norm or a document before."""
    out = docs.select("__doc", "__before", *keys).join(now.select("__doc", F.col("norm").alias("__a")), "__doc", "left")
    out = out.join(before.select(F.col("__doc").alias("__before"), F.col("norm").alias("__b")), "__before", "left").join(dots, "__doc", "left")
    value = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), fn.clip01(F.coalesce("dot", F.lit(0.0)) / (F.col("__a") * F.col("__b"))))
    return out.select(*keys, value.alias(name))


def _dots(now: DataFrame, before: DataFrame) -> DataFrame:
    """(__doc, dot): products of (__doc, __before, term, w) with the vectors (__doc, term, w) of the documents before."""
    v = before.select(F.col("__doc").alias("__before"), "term", F.col("w").alias("v"))
    return now.join(v.hint("merge"), ["__before", "term"]).groupBy("__doc").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))


def _norms(vectors: DataFrame) -> DataFrame:
    """(__doc, norm), summed in tasks before the shuffle."""
    return vectors.groupBy("__doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def continuity(df: DataFrame, entity: str, period: str, text_col: str, name: str = "continuity", low: int = 2, high: int = 4, min_df: int = 2, ident: str | None = None) -> DataFrame:
    """(ident, entity, period, name), a row a document: its similarity to the entity's one document of the period before.

    Null where the period before has none or several, and where either document has no term of the vocabulary; documents
    without a shared term have 0. Several documents of a period each have their own value. N and the frequencies
    count documents, empty ones too. ``ident`` names a row; without it rows are told apart, but not named.

    Vectors are joined as they are and divided by both lengths at the end, so they travel by term once and by pair once.
    Both joins are merges whatever the sizes: a table of vectors is many times as large as its compressed files look.
    """
    docs = adjacent(df, entity, period, text_col, ident)
    counts = written(_packed_counts(docs, ["__before", "__serves"], text_col, low, high))
    n = df.agg(F.count("*").alias("n"))
    dfs = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    paired = counts.where("__before is not null or __serves")
    w = written(paired.join(dfs.hint("merge"), "term").join(F.broadcast(n)).select("__doc", "__before", "__serves", "term", _raw_weight().alias("w")))  # n is one row
    norms = _norms(w)
    keys = [*([ident] if ident else []), entity, period]
    return _scored(docs, _dots(w.where("__before is not null").drop("__serves"), w.where("__serves")), norms, norms, keys, name)


#: Postings of a task, of which each leaves a row a pair, and of a bucket of terms in ``expanding_continuity``. Fixed values.
_TASK, _BUCKET = 1 << 25, 1 << 24


def expanding_continuity(df: DataFrame, entity: str, period: str, text_col: str, name: str = "continuity_expanding", low: int = 2, high: int = 4, min_df: int = 2, ident: str | None = None) -> DataFrame:
    """As ``continuity``, with vocabulary, frequencies and N from documents up to the later period of a pair only.

    A document travels with the text before it; n-grams are counted where both lie, and their postings are shuffled once, in
    compressed blocks by bucket of terms. Where a bucket's blocks meet, all of its frequencies are known, and a pair's weights as of its
    later period: what leaves is a bucket's part of the pair's product and norms. A bucket's blocks are held compressed in one task, so
    memory grows with a term's documents by some bytes each. Longer n-grams than four characters are rows of a plain join.
    """
    if high > 4:
        return _expanding_by_rows(df, entity, period, text_col, name, low, high, min_df, ident)
    keys = [*([ident] if ident else []), entity, period]
    texts = df.select(*keys, fn.vector_text(F.coalesce(F.col(text_col), F.lit(""))).alias("__t"))
    base = written(texts.withColumn("__doc", F.monotonically_increasing_id()))
    ids = base.select(entity, period, "__doc")
    before = _with_before(ids, _alone(ids, entity, period), entity, period)
    along = Window.orderBy(period)
    n = base.where(F.col(period).isNotNull()).groupBy(period).agg(F.count("*").alias("k"))
    n = n.select(period, F.sum("k").over(along).alias("__n"), (F.row_number().over(along) - 1).alias("__rank"))  # one row a period
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Texts are dealt once, for their own sake and as those before others, which then go where the others are.
    dealt = base.select("__doc", "__t").repartition(parts, "__doc")
    others = before.join(dealt.select(F.col("__doc").alias("__before"), F.col("__t").alias("__u")), "__before").select("__doc", "__u").repartition(parts, "__doc")
    rows = dealt.join(ids.join(F.broadcast(n), period).select("__doc", "__rank", "__n"), "__doc").join(others, "__doc", "left")
    most = 2 * (high - low + 1) * (base.agg(F.sum(F.length("__t"))).first()[0] or 0)
    tasks = max(1, min(parts, max(-(-most // _TASK), min(16, -(-most // (_TASK >> 3))))))
    made = rows.select("__doc", "__t", "__u", "__rank", "__n").mapInArrow(postings.blocks(low, high, tasks * max(2, -(-most // (tasks * _BUCKET)))), postings.BLOCKS)
    sums = made.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_gathered(postings.sums(min_df)), postings.SUMS)
    sums = sums.groupBy("__doc").agg(*[F.sum(c).alias(c) for c in ("dot", "now", "before")])
    value = F.when((F.col("now") > 0) & (F.col("before") > 0), fn.clip01(F.col("dot") / (F.sqrt("now") * F.sqrt("before"))))
    return base.select("__doc", *keys).join(sums, "__doc", "left").select(*keys, value.alias(name))


def _expanding_by_rows(df: DataFrame, entity: str, period: str, text_col: str, name: str, low: int, high: int, min_df: int, ident: str | None) -> DataFrame:
    """``expanding_continuity`` with a row a posting.

    Frequencies as of a period come from one window over (term, period) counts, which has a row for each period
    in which a term is asked for: a document is weighed as of its own period where it has one before it, and as of
    the next where it is one, by an equi-join.
    """
    docs = adjacent(df, entity, period, text_col, ident)
    with_period = docs.withColumn("__period", F.col(period))
    counts = written(_packed_counts(with_period, ["__before", "__serves", "__period"], text_col, low, high))
    n_new = df.groupBy(period).agg(F.count("*").alias("k"))
    n = n_new.select(F.col(period).alias("as_of"), F.sum("k").over(Window.orderBy(period)).alias("n"))  # one row a period
    roles = F.array(F.when(F.col("__before").isNotNull(), F.col("__period")), F.when(F.col("__serves"), F.col("__period") + 1))
    wanted = counts.where("__before is not null or __serves").select("*", F.explode(F.array_compact(roles)).alias("as_of"))
    # A document's own period counts it, the next one only asks.
    k = counts.groupBy("term", F.col("__period").alias("as_of")).agg(F.count("*").alias("k"))
    k = k.union(k.select("term", F.col("as_of") + 1, F.lit(0).cast("long"))).groupBy("term", "as_of").agg(F.sum("k").alias("k"))
    known = k.select("term", "as_of", F.sum("k").over(Window.partitionBy("term").orderBy("as_of")).alias("df")).where(F.col("df") >= min_df)
    w = wanted.join(known.hint("merge"), ["term", "as_of"]).join(F.broadcast(n), "as_of")
    w = written(w.select("__doc", "__before", (F.col("as_of") == F.col("__period")).alias("__now"), "term", _raw_weight().alias("w")))
    now, before = w.where("__now"), w.where("not __now")
    keys = [*([ident] if ident else []), entity, period]
    return _scored(docs, _dots(now.drop("__now"), before), _norms(now), _norms(before), keys, name)


def theme_continuity(df: DataFrame, entity: str, period: str, text_col: str, themes: dict[str, list[str]], name: str = "continuity_theme", ident: str | None = None) -> DataFrame:
    """(ident, entity, period, name), a row a document: cosine of keyword shares by category with the one document of the period before.

    Null where there is none or several, and where either has no keyword.
    """
    docs = adjacent(df, entity, period, text_col, ident)
    t = F.coalesce(F.col(text_col), F.lit(""))
    hs = [f"__h{i}" for i in range(len(themes))]
    v = docs.select(*[c for c in docs.columns if c != text_col], *[_hits(t, themes[k]).alias(h) for k, h in zip(sorted(themes), hs, strict=True)])
    b = v.where("__serves").select(F.col("__doc").alias("__before"), *[F.col(h).alias(f"b{h}") for h in hs])
    dot = reduce(lambda x, y: x + y, [F.col(h) * F.col(f"b{h}") for h in hs]).cast("double")
    na, nb = (reduce(lambda x, y: x + y, [F.col(p + h) * F.col(p + h) for h in hs]).cast("double") for p in ("", "b"))
    keys = [*([ident] if ident else []), entity, period]
    return v.join(b, "__before", "left").select(*keys, F.when((na > 0) & (nb > 0), fn.clip01(dot / F.sqrt(na) / F.sqrt(nb))).alias(name))


def pair_controls(df: DataFrame, entity: str, period: str, length: str, tier: str) -> DataFrame:
    """(entity, period, mean_log_length, diff_log_length, tier, tier_previous, tier_max, tier_changed, both_good) of adjacent documents."""
    from panelkit.operators.panel import previous

    p = previous(df.select(entity, period, length, tier), entity, period, [length, tier])
    a, b = F.log1p(length), F.log1p(f"{length}_previous")
    t, u = F.col(tier), F.col(f"{tier}_previous")
    there = u.isNotNull()
    return p.select(entity, period, ((a + b) / 2).alias("mean_log_length"), F.abs(a - b).alias("diff_log_length"), t.alias("tier"), u.alias("tier_previous"), F.when(there, F.greatest(t, u)).alias("tier_max"), F.when(there, t != u).alias("tier_changed"), F.when(there, (t <= 2) & (u <= 2)).alias("both_good"))


def metric_flag(df: DataFrame, entity: str, period: str, metric: str) -> DataFrame:
    """``df`` with metric_flag: first_period, missing_previous, empty_vector or ok."""
    first = df.groupBy(entity).agg(F.min(period).alias("__f"))
    n = df.groupBy(entity, (F.col(period) + 1).alias(period)).agg(F.count("*").alias("__n"))
    j = df.join(first, entity).join(n, [entity, period], "left")
    return j.withColumn("metric_flag", review_code([("first_period", F.col(period) == F.col("__f")), ("missing_previous", F.coalesce(F.col("__n") != 1, F.lit(True))), ("empty_vector", F.col(metric).isNull())])).drop("__f", "__n")


def shared_terms(df: DataFrame, entity: str, period: str, text_col: str, k: int = 10, low: int = 2, high: int = 4, ident: str | None = None) -> DataFrame:
    """(ident, entity, period, terms): the ``k`` n-grams that a document shares most with the one before; ties by term."""
    docs = adjacent(df, entity, period, text_col, ident)
    paired = docs.where("__before is not null or __serves").select("__doc", "__before", "__serves", text_col)
    c = written(term_counts(paired, ["__doc", "__before", "__serves"], text_col, low, high))
    b = c.where("__serves").select(F.col("__doc").alias("__before"), "term", F.col("c").alias("d"))
    both = c.where("__before is not null").join(b, ["__before", "term"]).select("__doc", "term", F.least("c", "d").alias("m"))
    r = F.row_number().over(Window.partitionBy("__doc").orderBy(F.desc("m"), "term"))
    top = both.withColumn("r", r).where(F.col("r") <= k)
    terms = top.groupBy("__doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " ").alias("terms"))
    return docs.join(terms, "__doc").select(*([ident] if ident else []), entity, period, "terms")


# -- provenance and extraction ---------------------------------------------------------------------


def source_tier(url: Column, ident: Column, listed: dict[int, list[str]], domains: dict[str, int], fallback: int | None = None) -> Column:
    """The tier of a source: by its id if listed, else by its domain, else the fallback."""
    out = fn.domain_class(url, {d: str(t) for d, t in domains.items()}, "").try_cast("int")
    for tier, ids in listed.items():
        out = F.when(ident.isin(ids), F.lit(tier)).otherwise(out)
    return F.coalesce(out, F.lit(fallback).cast("int"))


def provenance_conflicts(df: DataFrame, verified: Column, rules: dict[str, Column]) -> DataFrame:
    """Verified rows that some rule contradicts, with the first as ``conflict``."""
    return df.where(verified).withColumn("conflict", review_code(list(rules.items()), "")).where("conflict <> ''")


def labelled_values(df: DataFrame, doc: str, text_col: str, labels: list[str], following: int = 3, sep: str = r"[:\s]*") -> DataFrame:
    """(doc, label, value, line): the value after the first line that begins with a label, in the labels' order.

    An empty rest of the line is filled from up to ``following`` lines after it, up to a line that begins
    with a label. Lines of a document are an array in its row, so nothing is shuffled.
    """
    rows = df.select(doc, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("__l"))

    def starts(line: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.trim(line).startswith(x) for x in labels])

    def found(label: str, rank: int) -> Column:
        hits = F.filter(F.transform("__l", lambda line, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.trim(line).alias("line"))), lambda x: x["line"].startswith(label))
        return F.transform(hits, lambda x: F.struct(x["rank"].alias("rank"), x["i"].alias("i"), F.lit(label).alias("label"), F.trim(F.regexp_replace(F.substring(x["line"], F.lit(len(label) + 1), F.length(x["line"])), f"^{sep}", "")).alias("rest")))

    first = rows.withColumn("__h", F.array_min(F.concat(*[found(x, i) for i, x in enumerate(labels)]))).where("__h is not null")
    # A line that is a label ends the value: what follows is masked from there on.
    after = F.slice("__l", F.col("__h.i") + 2, F.lit(following))
    stop = F.array_position(F.transform(after, starts), True)
    cont = F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after)
    value = F.when(F.col("__h.rest") != "", F.col("__h.rest")).otherwise(fn.squeeze(F.array_join(cont, " ")))
    return first.select(doc, F.col("__h.label").alias("label"), F.nullif(value, F.lit("")).alias("value"), (F.col("__h.i") + 1).alias("line"))


def dated_changes(df: DataFrame, doc: str, text_col: str, pattern: str, date_pattern: str, date_format: str, sentence: str = r"[.;。；]\s*") -> DataFrame:
    """(doc, effective, old, new): changes that a pattern with two groups finds in a sentence that also has a date; distinct."""
    s = df.select(doc, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), sentence)).alias("s")).where(F.col("s").rlike(pattern))
    out = s.select(doc, F.try_to_date(F.nullif(F.regexp_extract("s", date_pattern, 0), F.lit("")), date_format).alias("effective"), F.trim(F.regexp_extract("s", pattern, 1)).alias("old"), F.trim(F.regexp_extract("s", pattern, 2)).alias("new"))
    return out.where("old <> new").distinct()


def notice_state(text: Column, old: Column, new: Column, event_year: Column, target_year: Column) -> Column:
    """YES, NO or UNKNOWN: whether a notice states the change from old to new in the target year.

    Both names must occur, old before new; a dated event of another year is NO, and silence is never NO.
    """
    a, b = F.call_function("locate", old, text), F.call_function("locate", new, text)
    stated = F.coalesce((a > 0) & (b > a), F.lit(False))
    return F.when(~stated | event_year.isNull(), F.lit("UNKNOWN")).when(event_year == target_year, F.lit("YES")).otherwise(F.lit("NO"))
