"""Quality rules: line faults, the base counts against a plain count, whole documents."""

import random
import re
import textwrap

import pytest

from promoscope.llm.line_quality import LineRules, clean_documents, judge, line_fault, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = LineRules()


def fault(line):
    return line_fault(line, WORD.findall(line), RULES)


@pytest.mark.parametrize("line,want", [
    ("A plain sentence ends here.", None), ("Home", "navigation"), ("Home Login Contact", "navigation"),
    ("one | two | three.", "navigation"), ("a » b » c.", "navigation"), ("One | bar only.", None),
    ("Please enable JavaScript to go on.", "boilerplate"), ("No end mark", "punctuation"), ("A sentence. And one that was cut", None),
    ("SHOUT!! ALL!! THE!! WAY!!", "punctuation"), ("sym*** bols### all### over$$$.", "punctuation"),
    ("Really?! he said, and left it there at last.", None), ("“Quoted.”", None), ("(In brackets.)", None),
])
def test_line_faults(line, want):
    assert fault(line) == want


def test_very_long_words_take_no_long_time():
    assert fault("#" * 500_000 + "x") == "punctuation"
    assert fault("#" * 500_000 + ".") is None and fault("a?! " * 3 + "b.") == "punctuation"


def plain_repeats(words):
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


def test_repeated_words():
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        assert repeated_words(words) == plain_repeats(words)


def test_base_counts():
    rng = random.Random(4)
    bits = ["word", "two", "é😀", "#", "$%", "|", "\n", " ", "\t", "\r", "same line\n", "x."]
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 120)))
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeat = plain_repeats(words)
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
                len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words))
        assert judge(text, RULES)[:6] == want


def sentences(n):
    return "\n".join(" ".join(f"Word{i}x{k}" for k in range(9)) + "." for i in range(n))


def test_documents_that_lose_too_much_go():
    menu = "\n".join("Home | News | Sport | Weather | item%d" % i for i in range(40))
    assert judge(sentences(20), RULES)[6]
    good = judge(sentences(20) + "\nHome | News | Sport", RULES)
    assert good[6] and good[-1] == sentences(20)
    assert not judge(sentences(10) + "\n" + menu, RULES)[6]
    assert judge(None, RULES)[:2] == (0, 0) and judge(None, RULES)[5] and not judge(None, RULES)[6]


def test_clean_documents(spark):
    rows = [(1, sentences(20) + "\nHome", "en", "s", 0), (2, "short", "en", "s", 0), (3, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = clean_documents(df)
    assert out.schema == df.schema
    assert [tuple(r) for r in out.collect()] == [(1, sentences(20), "en", "s", len(sentences(20)))]


@pytest.mark.parametrize("line,before,after,want", [
    ("this line of prose was wrapped in", "", "the middle of it.", None), ("This line of prose was wrapped in", "", "the middle of it.", None),
    ("and so was this one before a", "A sentence that began here", "Name of note.", None),
    ("and so was this one before a", "A sentence.", "Name of note.", "punctuation"), ("Read More About It Now", "", "Next Title", "punctuation"),
    ("too short here", "goes on", "and on.", "punctuation"), ("das war ein langer Satz der", "", "über die Zeile ging.", None),
    ("это строка прозы которая идёт дальше", "", "на новой строке.", None),
])
def test_wrapped_prose(line, before, after, want):
    assert line_fault(line, WORD.findall(line), RULES, WORD.findall(before), WORD.findall(after)) == want


def prose(sentence, n, end):
    """Sentences whose words differ (by a number), so that none repeats."""
    return " ".join(" ".join(f"{w}{i}" for w in sentence.split()) + end for i in range(n))


CLEAN = {
    "one long line that names a privacy policy once": prose("Word of a long article that goes on", 400, ".") + " See our privacy policy here.",
    "two bars in a long line": prose("Word of a table in prose", 60, ".") + " a | b | c.",
    "Hindi": prose("यह वाक्य है और यह पाठ बिलकुल साफ़ है", 30, "।"), "Urdu": prose("یہ جملہ ہے اور یہ متن صاف ہے", 30, "۔"),
    "Amharic": prose("ይህ ዓረፍተ ነገር ቁጥር ነው", 30, "።"),
    "wrapped at 60 characters": textwrap.fill(prose("a sentence that is long enough to be wrapped twice or more before it comes to its end", 30, "."), 60),
}


@pytest.mark.parametrize("name", CLEAN)
def test_clean_texts_are_kept(name):
    got = judge(CLEAN[name], RULES)
    assert got[6] and got[10] < 0.1, got[:-1]
