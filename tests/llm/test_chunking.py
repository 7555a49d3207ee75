import random

import pytest

from ledgerloom.llm import chunking as C

ENDS = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " ", "\n\n", "\n\n\n"]


def _check(text, lim):
    pieces = C.split_text(text, lim)
    lines = text.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    assert pieces[0][0] == pieces[0][1] == 0 and pieces[-1][2] == len(text)
    for i, (start, new, end, why) in enumerate(pieces):
        piece = text[start:end]
        assert len(piece.encode()) <= lim.max_bytes or end - start == 1
        assert len(piece.splitlines()) <= lim.max_lines
        if i:
            before = pieces[i - 1]
            assert new == before[2] and before[0] < start <= new and len(text[start:new].encode()) <= lim.overlap_bytes
            # cut inside a line only if the line alone is too long
            for a, x in zip(starts, lines):
                body = x.splitlines()[0]
                if a < new < a + len(body):
                    assert len(body.encode()) > lim.max_bytes
    assert "".join(text[n:e] for _, n, e, _ in pieces) == text
    small = len(text.encode()) <= lim.max_bytes and len(text.splitlines()) <= lim.max_lines
    assert (len(pieces) == 1) == small or not text
    return pieces


@pytest.mark.parametrize("seed", range(40))
def test_limits_overlap_and_round_trip(seed):
    rng = random.Random(seed)
    words = ["word", "Grün.", "Ende! ", "# Head", "東京", "x" * rng.choice([3, 90]), ""]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", rng.choice(ENDS)]) for _ in range(rng.randrange(300)))
    _check(text, C.Limits(rng.choice([20, 60, 200]), rng.choice([2, 5, 60]), rng.choice([0, 8, 15])))


def test_edges():
    lim = C.Limits(30, 3, 8)
    assert C.split_text("", lim) == [(0, 0, 0, "start")]
    _check("a" * 1000, lim)
    _check("é" * 100, lim)
    _check("\n" * 50, lim)
    _check("\r\n" * 50, lim)
    exact = "a" * 30 + "\n" + "b" * 30
    assert all(len(exact[s:e].encode()) <= 30 for s, _, e, _ in _check(exact, lim))
    big = _check("word " * 200_000, C.Limits())
    assert len(big) > 300


def test_natural_boundaries_first():
    text = "# One\n\n" + "Sentence here. " * 10 + "\n\n# Two\n\n" + "Other text there. " * 10
    pieces = C.split_text(text, C.Limits(200, 60, 0))
    assert any(why == "section" and text[new:].startswith("# Two") for _, new, _, why in pieces)
    assert all(why in ("start", "section", "paragraph", "line", "sentence") for *_, why in pieces)


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
def test_sections_and_paragraphs_whatever_the_line_end(eol):
    ends = lambda level, text: [m.end() for m in C._BEFORE[level].finditer(text)]
    line, blank = f"a{eol}b", f"a{eol}{eol}b"
    assert ends("paragraph", line) == ends("section", line) == ends("section", blank) == []
    assert ends("paragraph", blank) == [len(blank) - 1]
    two = f"a{eol}{eol}{eol}b"
    assert ends("section", two) == [len(two) - 1]
    assert ends("section", f"a{eol}# b") == [1 + len(eol)]


def test_operator(spark):
    long_line = "x" * 3001
    rows = [("a", "short"), ("b", "l\n" * 61), ("c", long_line + "\n" + "y " * 2000 + "\nz"), ("c", long_line + "\n" + "y " * 2000 + "\nz"), ("d", None), ("e", ""), ("f", "x" * 3000), ("g", "l\n" * 60)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "id string, body string, piece_no int, text string")
    assert {tuple(r) for r in C.oversized_lines(df, "id", "body").collect()} == {("b", 0), ("c", 0), ("c", 1), ("c", 2)}
    pieces = C.split_oversized(df, "id", "body").collect()
    for k, body in dict(rows).items():
        own = sorted((p for p in pieces if p.id == k), key=lambda p: p.piece_no)
        assert [p.piece_no for p in own] == list(range(1, len(own) + 1))
        assert "".join(p.text[p.new_char - p.start_char :] for p in own) == (body or "")
        assert all(p.n_bytes == len(p.text.encode()) <= 3000 and p.n_lines == len(p.text.splitlines()) <= 60 for p in own)
    assert C.split_oversized(df.limit(0), "id", "body").count() == 0
