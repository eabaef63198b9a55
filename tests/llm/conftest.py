import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (text[, lang[, source]]) rows, with an extra column whose name clashes with internals."""

    def build(rows, ids=None):
        out = []
        for k, r in enumerate(rows):
            text, lang, source = (list(r) + [None] * 3)[:3] if isinstance(r, tuple) else (r, "en", "s0")
            out.append((ids[k] if ids else k, text, lang, source, None if text is None else len(text), "extra"))
        return spark.createDataFrame(out, f"{DOCS}, shard string")

    return build


#: Null, empty, blank, one word, unusual letters, a very long word, a long text, repeats.
ODD = [None, "", "   \n\t", "word", "Ünïcödé ñ 漢字 \U0001f600", "x" * 20000, "the quick brown fox " * 3000, "word", "a\x00b", "<|endoftext|> in a text<|endoftext|>", "tab\tline\r\nend  "]
