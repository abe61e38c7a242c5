"""Plain text: compatibility form, character references, markup and TeX commands out, one space between words."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes that count as a hyphen, TeX commands whose argument is text.
DASHES = "[\u2010-\u2015\u2212]"
TEXT_COMMAND = r"\\(?:boldsymbol|mathbf|mathrm|text|operatorname)\s*\{([^{}]*)\}"


#: What is replaced, in this order; commands may be nested three deep.
STEPS = (
    ("<[^>]+>", " "), (r"\\times", "\u00d7"), (r"\\mu\b", "\u00b5"), *[(TEXT_COMMAND, r"\1")] * 3, (r"\\[A-Za-z]+", " "), ("[{}$]", ""), (DASHES, "-"),
    (r"[\s\x0B\x1C-\x1F\x{85}\pZ]+", " "),
)


def compatible(text: Column) -> Column:
    """A text's compatibility form (NFKC) with character references decoded, nothing else; null for null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return _decoded(texts)

    return run(text)


def _decoded(texts: pa.Array) -> pa.Array:
    import html

    import pyarrow.compute as pc

    named = pc.fill_null(pc.match_substring(texts, "&"), False)
    if pc.any(named).as_py():
        texts = pc.replace_with_mask(texts, named, pa.array([html.unescape(t) for t in texts.filter(named).to_pylist()], texts.type))
    return pc.utf8_normalize(texts, "NFKC")


def plain_text(text: Column) -> Column:
    """A text in compatibility form (NFKC) with character references decoded, without tags, TeX commands and braces, dashes as
    hyphens, words parted by one space; empty for null.

    Arrow batches and vectorized kernels: no built-in function has the form, and the JVM's matcher takes ten times as long.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        out = _decoded(pc.fill_null(texts, "").cast(pa.string()))
        for pattern, new in STEPS:
            out = pc.replace_substring_regex(out, pattern, new)
        return pc.utf8_trim(out, " ")

    return run(text)


def plain_sql(text: str) -> str:
    """The same in DuckDB for texts that are their own compatibility form."""
    text = f"coalesce({text}, '')"
    for pattern, new in STEPS[:-1]:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
