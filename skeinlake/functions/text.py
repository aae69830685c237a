"""Text functions: tokens, query normalisers, paths and predicates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token characters: letters, digits and the marks that names and paths are made of.
TOKEN = r"[\p{L}\p{N}._:/#<>?!-]+"
# Language of a path by its extension.
LANGUAGES = {
    "typescript": ("ts", "tsx"), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py",), "go": ("go",),
    "rust": ("rs",), "java": ("java",), "markdown": ("md", "mdx"),
}
# First parts of a path that do not belong in an index.
SUSPICIOUS = ("node_modules", "dist", "build", "vendor", ".git", "target", "bin", "obj", "__pycache__", ".next", "coverage")


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with a diacritic, and their base letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folds()


def fold(text: Column) -> Column:
    """Lower case without the diacritics of Latin letters."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def tokens(text: Column) -> Column:
    """array<string>: the folded tokens in order, repeats kept."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def fold_text(text: str) -> str:
    return text.lower().translate(str.maketrans(_MARKED, _PLAIN))


def query_terms(query: str) -> list[str]:
    """Distinct folded terms of a query, in order; a document must hold all of them."""
    found = "".join(c if unicodedata.category(c)[0] in "LN" or c in "._:/#<>?!-" else " " for c in fold_text(query)).split()
    return list(dict.fromkeys(found))


def query_phrase(query: str) -> str | None:
    """The phrase of a substring query: trimmed, one pair of outer quotes taken off; None if empty."""
    phrase = query.strip()
    if len(phrase) >= 2 and phrase[0] == phrase[-1] == '"':
        phrase = phrase[1:-1]
    return phrase or None


def wants_substring(query: Column) -> Column:
    """Whether a query without keyword hits is looked up as a substring: quoted as a whole, or with
    `::`, `/` or `.` in it."""
    trimmed = F.trim(query)
    return trimmed.rlike(r'(?s)^".+"$') | trimmed.contains("::") | trimmed.contains("/") | trimmed.contains(".")


def route(query: Column, keyword_hits: Column) -> Column:
    """kw if any keyword hit, else sub where wants_substring, else none."""
    return F.when(keyword_hits > 0, "kw").when(wants_substring(query), "sub").otherwise("none")


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    out = None
    for language, extensions in LANGUAGES.items():
        hit = extension.isin(*extensions)
        out = F.when(hit, language) if out is None else out.when(hit, language)
    return out.otherwise("text")


def first_part(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def is_suspicious(prefix: Column) -> Column:
    return prefix.isin(*SUSPICIOUS)


def slug(heading: Column) -> Column:
    """Lower case; letters, digits and hyphens; white space to single hyphens."""
    kept = F.regexp_replace(F.lower(F.trim(heading)), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), r"-+", "-")


def title_slug(title: Column, most: int = 64) -> Column:
    """A file name: ASCII lower case, other characters to single hyphens, at most `most` long."""
    plain = F.regexp_replace(F.regexp_replace(fold(title), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.regexp_replace(F.substring(plain, 1, most), r"-+$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, where a character beyond the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def has_nul(content: Column, within: int = 4096) -> Column:
    """Whether a binary column has a zero byte among its first bytes."""
    return F.position(F.lit(b"\x00"), F.substring(content, 1, within)) > 0


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))




def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; none under three characters."""
    chars = F.split(F.lower(text), "")
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    # zipped and not looked up by place: within a lambda the split would be made anew for each
    runs = F.arrays_zip(*[F.slice(chars, i, n).alias(f"c{i}") for i in (1, 2, 3)])
    return F.array_distinct(F.transform(runs, lambda r: F.concat(*[r.getField(f"c{i}") for i in (1, 2, 3)])))
