import json
import random
import time

from pyspark.sql import functions as F

from quire.functions.jsonx import (
    _BRACES,
    _is_json,
    checked_summary,
    clean_questions,
    extract_json,
    find_json,
    normalized_summary,
    strict_json,
    string_at,
    strings_at,
    usable_strings_at,
)

VALUES = [
    {"city": "Oslo", "rank": 3},
    {"rows": [[1, 2], []], "note": "curly } and { in a string", "quote": 'a \\" b'},
    {"deep": {"er": {"est": [None, True, 2.5]}}},
    ["list", {"of": "things"}],
]
# How a model may dress up a value; every one is undone.
WRAPPERS = [
    "{}",
    "\n\t {} \n",
    "```json\n{}\n```",
    "```JSON {}```",
    "```\n{}```",
    "<think>first I try [1] and then {{\"no\": 1}}</think>\n{}",
    "<THINK>one</THINK><think>two\n</think>```json\n{}\n```",
]
# These hold an object amid other text.
AROUND = [
    "The answer you wanted: {} and nothing else.",
    "{{braces}} that are no JSON, then {}",
    "{{\"open\": {}",
    "<think>no end in sight {}",
]


def dressed():
    for value in VALUES:
        text = json.dumps(value)
        for wrapper in WRAPPERS:
            yield wrapper.replace("{{", "\0").replace("}}", "\1").replace("{}", text).replace("\0", "{").replace("\1", "}"), value
        if isinstance(value, dict):
            for wrapper in AROUND:
                yield wrapper.replace("{{", "\0").replace("}}", "\1").replace("{}", text).replace("\0", "{").replace("\1", "}"), value


NOTHING = ["plain words", "", "   ", '{"half": [1, 2', "}{", "{'single': 1}", '{"n": NaN}', "```json\n```", '{"x": 1,}']


def test_payload_is_found_in_every_dress(column):
    cases = list(dressed())
    texts = [c[0] for c in cases] + NOTHING
    found = column(extract_json, texts)
    for (raw, want), got in zip(cases, found):
        assert json.loads(got) == want, raw
        assert json.loads(find_json(raw)) == want, raw
    assert found[len(cases):] == [None] * len(NOTHING)


def test_halves_of_surrogate_pairs_are_replaced(column):
    raw = {
        r'{"s": "cut \ud83d"}': "cut �",
        r'{"s": "\udE00 tail"}': "� tail",
        r'{"s": "😀"}': "\U0001f600",
        r'{"s": "\\ud83d"}': r"\ud83d",
        r'noise {"s": "\ud83dx😀\ude00"} noise': "�x\U0001f600�",
    }
    got = column(lambda c: string_at(F.try_parse_json(extract_json(c)), "$.s"), list(raw))
    assert got == list(raw.values())


def test_numbers_out_of_range_do_not_lose_the_payload(column):
    texts = ['{"summary":"x","n":1e400}', 'so: {"summary":"x","n":-1e999} ok']
    assert column(lambda c: extract_json(c).isNotNull(), texts) == [True, True]


def first_object(text):
    """The rule by definition: from each brace on, to where it is closed."""
    for start in (i for i, c in enumerate(text) if c == "{"):
        depth, quoted = 0, False
        for mark in _BRACES.finditer(text, start):
            sign = mark.group()
            if sign == '"':
                quoted = not quoted
            elif not quoted and sign in "{}":
                depth += 1 if sign == "{" else -1
                if depth == 0:
                    if _is_json(text[start : mark.end()]):
                        return text[start : mark.end()]
                    break
    return None


def test_one_pass_equals_the_rule():
    rng = random.Random(17)
    pieces = ["{", "}", '"', "\\", "k", ":", "7", '"s"', '{"k":7}', "{}", " ", ","]
    for _ in range(20_000):
        text = "~" + "".join(rng.choice(pieces) for _ in range(rng.randrange(20)))
        assert find_json(text) == first_object(text), text


def test_scan_takes_linear_time():
    started = time.time()
    for piece in ("{", '{"k":', '{"', "\\{", "{}"):
        find_json("~" + piece * 150_000)
    assert time.time() - started < 20


def test_arrays_of_strings(column):
    cases = [
        ('["north", "south"]', ["north", "south"], ["north", "south"]),
        ('[]', [], []),
        ('["kept", "\\t ", " inner space "]', ["kept", " inner space "], ["kept", "\t ", " inner space "]),
        ('["only", 4.5, false, null, ["nested"]]', ["only"], None),
        ('"not a list"', [], None),
        ('{"2": "two"}', [], None),
        ("null", [], None),
    ]
    texts = ['{"items": %s}' % c[0] for c in cases] + ['{"other": 1}']
    assert column(lambda c: usable_strings_at(strict_json(c), "$.items"), texts) == [c[1] for c in cases] + [[]]
    assert column(lambda c: strings_at(strict_json(c), "$.items"), texts) == [c[2] for c in cases] + [None]


def test_strict_json_takes_one_whole_value(column):
    whole = ['{"k": [1]}', "\n[true]\t", '"word"', "null", "-0.5e3"]
    broken = ["[1] [2]", '{"k": 1}}', "2],[3", '2},{"k":3', "[1,]", "", "[", "Infinity", "7,8", "tru"]
    assert column(lambda c: strict_json(c).isNotNull(), whole + broken) == [True] * len(whole) + [False] * len(broken)


def test_summary_rules(column):
    loose = {"title": "\tReport ", "documentType": None, "summary": " body\n", "keyPoints": ["one", 2], "mainIdeas": {}, "more": 0}
    got = column(lambda c: normalized_summary(strict_json(c)), [json.dumps(loose), "[]", '{"title": "no body"}', '{"summary": "\\n"}', '{"summary": ["x"]}'])
    assert got[0].asDict() == {
        "title": "Report", "document_type": "Document", "summary": "body", "key_points": ["one"], "main_ideas": [], "entities": [], "action_items": [],
    }
    assert got[1:] == [None] * 4
    whole = {"title": "t", "documentType": "", "summary": "", "keyPoints": ["p"], "mainIdeas": [], "entities": ["e", "f"], "actionItems": []}
    broken = [dict(whole, actionItems=[None]), dict(whole, title=1), {k: v for k, v in whole.items() if k != "entities"}, "text", []]
    checked = column(lambda c: checked_summary(strict_json(c)), [json.dumps(x) for x in (whole, *broken)])
    assert checked[0].entities == ["e", "f"] and checked[1:] == [None] * len(broken)


def test_questions_are_cleaned(column):
    raw = json.dumps({"questions": ["\nWho ", "When?", " ", None] + [f"What {i}" for i in range(8)]})
    asked = column(lambda c: clean_questions(strict_json(c), 5), [raw])
    assert asked == [["Who?", "When?", "What 0?", "What 1?", "What 2?"]]
    assert column(lambda c: F.size(clean_questions(strict_json(c), 5)), ['{"questions": "x"}', "7"]) == [0, 0]
