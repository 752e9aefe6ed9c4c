"""Column expressions shared by the library's jobs. Lengths and offsets count code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
BLANK, BLANKS, ENDS = _BLANK, _BLANK + "+", rf"^{_BLANK}+|{_BLANK}+\z"


def _fold_table() -> tuple[str, str]:
    """Letters and their bases, from the Unicode decompositions: a Latin letter with one mark folds to its letter of a to z; those
    with several marks or without a decomposition stay, as in a full-text index that folds by single marks."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        whole = unicodedata.normalize("NFD", c)
        if len(whole) == 2 and unicodedata.combining(whole[1]) and whole[0].lower() in az:
            pairs[c] = whole[0].lower()
    return "".join(pairs), "".join(pairs.values())


#: Letters folded to their base for search tokens, after lower(); marks that combine with the letter before them are dropped.
ACCENTED, PLAIN = _fold_table()
MARKS = r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"
#: File types by extension.
FILE_TYPES = {"pdf": "pdf", "md": "markdown", "doc": "doc", "docx": "docx", "txt": "text", "html": "html"}
#: Words that never become search keywords.
STOP_WORDS = (
    "的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 里 吗 呢 啊 什么 怎么 为什么 "
    "the a an is are was were be been being have has had do does did will would should could may might can of in on at to for with by from "
    "as this that it its what how why when where which"
).split()


def js_trim(c: Column) -> Column:
    """Strip Unicode white space and the byte-order mark on both ends."""
    return F.regexp_replace(c, ENDS, "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (js_trim(c) == "")


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only, as a case-insensitive LIKE compares."""
    return F.translate(c, AZ, az)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def file_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def title_of(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def display_name(path: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(basename(path), F.lit("")), title, F.lit(""))


def fold_tokens(c: Column) -> Column:
    """Search tokens: runs of letters and digits, lower-cased, accents removed. Texts are decomposed where they hold
    marks only, so most pass through one translation and one pattern."""
    low = F.lower(c)
    bare = F.when(low.rlike(MARKS), F.regexp_replace(low, MARKS, "")).otherwise(low)
    return F.regexp_extract_all(F.translate(bare, ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}\p{Co}]+"), 0)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def question_keywords(q: Column) -> Column:
    """English words of two letters and more, then 2-grams of what is neither Latin letter, digit nor
    space; without stop words, distinct, in order of first use."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    q = F.coalesce(q, F.lit(""))
    words = F.filter(F.regexp_extract_all(F.lower(q), F.lit("[a-z]+"), 0), lambda w: F.length(w) >= 2)
    rest = F.regexp_replace(q, rf"[a-zA-Z0-9]|{_BLANK}", "")
    grams = let(rest, lambda r: F.when(F.length(r) >= 2, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.concat(words, grams), lambda w: ~F.array_contains(stop, w)))


def fts_query(q: Column) -> Column:
    """Quoted keywords joined by OR; without keywords the whole trimmed text as one phrase; blank: ''."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    words = question_keywords(q)
    return F.when(is_blank(q), "").when(F.size(words) > 0, F.array_join(F.transform(words, quoted), " OR ")).otherwise(quoted(js_trim(q)))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[。！？；\n\r.!?;]+"), js_trim), lambda s: F.length(s) >= 4)


def truncate_for_model(c: Column, limit: int = 4000) -> Column:
    note = F.concat(F.lit(f"\n\n[注：已使用文档前 {limit} 字，共 "), F.length(c).cast("string"), F.lit(" 字]"))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), note)).otherwise(c)


def cut_with_dots(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def model_list(c: Column) -> Column:
    """Parts of a model's list answer; null gives an empty list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，、]"), js_trim), lambda x: x != "")


#: The order and patterns of markup removal are part of the result.
CLEANING = [
    ("\r\n", "\n"), ("\r", "\n"),
    (rf"(?m)^{_BLANK}*#+{_BLANK}*", ""), (rf"(?m)^{_BLANK}*[-*+]{_BLANK}*", ""), (rf"(?m)^{_BLANK}*\d+[.)]{_BLANK}*", ""), (rf"(?m)^{_BLANK}*>{_BLANK}*", ""),
    (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"_{2}(.+?)_{2}", "$1"), (r"_(.+?)_", "$1"),
    (r"`{3}[^`]*`{3}", ""), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]", "$1"), (r"<[^>]+>", ""),
    (r"[^\u0020-\u007E\u00A0-\u00FF\u2000-\u206F\u3000-\u303F\u3040-\u309F\u30A0-\u30FF\u4e00-\u9fff\uff00-\uffef\n\r]", ""),
    (r"\n{3,}", "\n\n"), (r"[ \t]+", " "),
]


def clean_text(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for pattern, to in CLEANING:
        out = F.regexp_replace(out, pattern, to)
    return js_trim(out)


def text_to_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    parts = F.filter(F.transform(F.split(out, rf"\n{_BLANK}*\n"), js_trim), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))), "")


def highlight(text: Column, query: Column) -> Column:
    """Mark case-insensitive literal matches; an empty query changes nothing."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(query, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(F.coalesce(query, F.lit("")) == "", text).otherwise(F.regexp_replace(text, quoted, F.lit('<span class="highlight-keyword">$0</span>')))


def pdf_gate(text: Column, pages: Column) -> Column:
    """'ok', 'image' for a text layer that is missing, 'encrypted' for one that is too thin."""
    size, n = F.length(js_trim(F.coalesce(text, F.lit("")))), F.coalesce(F.nullif(pages, F.lit(0)), F.lit(1))
    return F.when(size == 0, "image").when((size < 100) & ((n > 1) | (size < 20)), "encrypted").otherwise("ok")


#: Error type by code, and by parts of the message in order.
ERROR_CODES = {
    "ECONNREFUSED": "network_connection", "ECONNRESET": "network_reset", "ENOTFOUND": "dns_resolution", "ETIMEDOUT": "timeout", "ESOCKETTIMEDOUT": "timeout",
    "EHOSTUNREACH": "network_connection", "ENETUNREACH": "network_connection", "EPROTO": "ssl_tls", "CERT_HAS_EXPIRED": "ssl_tls", "UNABLE_TO_VERIFY_LEAF_SIGNATURE": "ssl_tls",
    "DEPTH_ZERO_SELF_SIGNED_CERT": "ssl_tls", "SELF_SIGNED_CERT_IN_CHAIN": "ssl_tls", "ERR_TLS_CERT_ALTNAME_INVALID": "ssl_tls",
}
ERROR_PHRASES = [
    ("ssl_tls", ["ssl", "tls", "certificate", "cert"]), ("timeout", ["timeout", "超时"]), ("dns_resolution", ["dns", "enotfound", "getaddrinfo"]),
    ("network_connection", ["econnrefused", "connection refused", "连接被拒绝"]), ("network_reset", ["econnreset", "connection reset", "连接重置"]),
    ("authentication", ["unauthorized", "invalid key", "api key", "认证", "授权"]), ("rate_limit", ["rate limit", "too many requests", "频率", "配额"]),
]
NETWORK = ["network_connection", "network_reset", "dns_resolution", "timeout", "ssl_tls"]
RETRYABLE = ["network_connection", "network_reset", "timeout", "rate_limit"]


def error_type(code: Column, status: Column, message: Column) -> Column:
    by_code = F.try_element_at(F.create_map(*[F.lit(x) for pair in ERROR_CODES.items() for x in pair]), F.coalesce(code, F.lit("")))
    by_status = F.when(status.isin(401, 403), "authentication").when(status == 429, "rate_limit").when((status >= 400) & (status < 500), "http_status").when(status >= 500, "api_error")
    low, by_message = F.lower(F.coalesce(message, F.lit(""))), F.lit(None).cast("string")
    for kind, phrases in reversed(ERROR_PHRASES):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        by_message = F.when(hit, kind).otherwise(by_message)
    return F.coalesce(by_code, by_status, by_message, F.lit("unknown"))


def is_network_error(kind: Column) -> Column:
    return kind.isin(NETWORK)


def is_retryable(kind: Column) -> Column:
    return kind.isin(RETRYABLE)


def answer(raw: Column, output_only: bool = False) -> Column:
    """struct(text, error) of a model's JSON response: the trimmed text of the first accepted shape, or why there
    is none: 'api: ' and the service's message, 'format' for an unknown shape, 'json' for broken JSON.
    ``output_only`` accepts nothing but ``output.text``."""
    get = lambda p: F.get_json_object(raw, p)
    broken = F.try_parse_json(raw).isNull()
    chat, output, bare = get("$.choices[0].message.content"), F.nullif(get("$.output.text"), F.lit("")), F.nullif(get("$.text"), F.lit(""))
    found = output if output_only else F.when(get("$.choices[0].message").isNotNull(), chat).otherwise(F.coalesce(output, bare))
    error = F.when(broken, "json").when(get("$.error").isNotNull(), F.concat(F.lit("api: "), F.coalesce(get("$.error.message"), F.lit("")))).when(found.isNull(), "format")
    return F.struct(F.when(error.isNull(), js_trim(found)).alias("text"), error.alias("error"))


def answer_text(raw: Column) -> Column:
    """Text of a model's JSON response in any of its accepted shapes, trimmed; null if it has none."""
    return answer(raw)["text"]


CITATION_TITLE = "引用来源"


def enforce_citations(answer: Column, names: Column) -> Column:
    """Replace the first section titled with sources by numbered ``names``, or append it; no names: as is."""
    lines = F.array_join(F.transform(names, lambda n, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), n)), "\n")
    section = F.concat(F.lit(CITATION_TITLE + "\n"), lines)
    parts = F.split(F.concat(F.lit("\n"), answer), "\n## ")
    title = lambda p: js_trim(F.regexp_replace(F.substring_index(p, "\n", 1), rf"[:：]{_BLANK}*\z", ""))
    is_it = F.transform(parts, lambda p, i: (i > 0) & (title(p) == CITATION_TITLE))
    at = F.array_position(is_it, F.lit(True))
    put = F.substring(F.array_join(F.transform(parts, lambda p, i: F.when(i + 1 == at, F.concat(section, F.lit("\n"))).otherwise(p)), "\n## "), 2, 2_000_000_000)
    return F.when(F.size(names) <= 0, answer).when(at > 0, put).otherwise(F.concat(F.regexp_replace(answer, rf"{_BLANK}+$", ""), F.lit("\n\n## "), section))
