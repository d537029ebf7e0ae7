from pyspark.sql import functions as F

from newsloom.functions import text

SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def test_whitespace_agrees_with_the_standard_library(evaluate):
    cases = [f"{s}a{s}{s}b{s}" for s in SPACES] + [SPACES, "", "a", "a\u200bb", "\ufeffa"]
    got = evaluate([(c,) for c in cases], "t string", text.collapse(F.col("t")), text.strip(F.col("t")), text.lstrip(F.col("t")))
    assert got == [(" ".join(c.split()), c.strip(), c.lstrip()) for c in cases]


def test_lines_agree_with_the_standard_library(evaluate):
    ends = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    cases = [f"a{e}{e}b{e}" for e in ends] + ["", "\n", "a", "\n\na", "a\n\n"]
    assert evaluate([(c,) for c in cases], "t string", text.lines_of(F.col("t"))) == [c.splitlines() for c in cases]


FRONT_MATTER = [
    ("---\na: b\n---\n# T\nx", "# T\nx"),
    ("---\n# T", "---\n# T"),
    ("# T\nx\n---\ny", "# T\nx\n---\ny"),
    ("  \n---\nk: v--- \n---\n\n\nbody", "body"),
    ("---\n---\nbody", "body"),
    ("--- x\nq---\n  ---  \nz", "z"),
    ("---\na ---\nb\n---\nc", "c"),
    ("\n\nplain", "\n\nplain"),
    ("---\na\n---", ""),
    ("", ""),
]


def test_drop_front_matter(evaluate):
    got = evaluate([(t,) for t, _ in FRONT_MATTER], "t string", text.drop_front_matter(F.col("t")))
    assert got == [want for _, want in FRONT_MATTER]


def test_heading(evaluate):
    cases = [
        ("# T \nx", "T", "x"),
        ("# T\n\n\n  x", "T", "x"),
        ("# \nx", "Weekly AI News", "x"),
        ("\n\n# T\nx", "T", "\n\n# T\nx"),
        ("x\n# T", "Weekly AI News", "x\n# T"),
        (" # T\nx", "Weekly AI News", " # T\nx"),
        ("## T\nx", "Weekly AI News", "## T\nx"),
        ("# T", "T", ""),
        ("", "Weekly AI News", ""),
    ]
    got = evaluate([(t,) for t, *_ in cases], "t string", text.heading_title(F.col("t")), text.drop_heading(F.col("t")))
    assert got == [(title, body) for _, title, body in cases]


def test_rendering(evaluate):
    block = text.digest_block(*(F.col(c) for c in "abcde"))
    rows = [("T", "u", None, "c", "s\nt"), ("T", "u", "", "c", None)]
    assert evaluate(rows, "a string, b string, c string, d string, e string", block) == [
        "#### T\n- URL: u\n- Published: unknown\n- Collected: c\n- Summary:\n  s\nt\n",
        "#### T\n- URL: u\n- Published: unknown\n- Collected: c\n- Summary:\n  \n",
    ]
    head = text.front_matter(F.lit("T"), F.lit("2026-02-06"), ["x", "y"], "l")
    assert evaluate([(1,)], "a int", head) == [
        "---\ntitle: T\ndescription:\ndate: 2026-02-06\nscheduled: 2026-02-06\ntags:\n  - x\n  - y\nlayout: l\n---\n"
    ]
    link = text.back_link(F.lit(2026), F.lit(6), F.lit("news_2026_06"))
    assert evaluate([(1,)], "a int", link) == ["\n\n---\n\n- [AI news summary — 2026-06](../weekly_news/news_2026_06)\n"]


def test_file_stem(evaluate):
    rows = [("a/b/news_2026_06.md",), ("news.tar.gz",), ("x",), ("/a/.hidden",), ("a/b.md/",)]
    assert evaluate(rows, "p string", text.file_stem(F.col("p"))) == ["news_2026_06", "news.tar", "x", ".hidden", "b"]
