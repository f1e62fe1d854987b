import random

import brute
from quire.functions.split import document_sample, retrieval_chunks, summary_chunks

MARKS = ["\n\n", "! ", "? ", ". ", "\n", " ", " ", ", "]


def prose(rng, units, mark_every=6):
    """Random words with a mark now and then, about so many units long."""
    out, size = [], 0
    while size < units:
        word = "".join(rng.choices("abcdeé", k=rng.randint(1, 11)))
        mark = rng.choice(MARKS) if rng.randrange(mark_every) == 0 else " "
        out.append(word + mark)
        size += len(word) + len(mark)
    return "".join(out)


def edge_texts():
    """Lengths around every limit, with and without places to cut."""
    texts = ["", "\t\n", " a ", "one line"]
    for limit in (40, 600, 1_200, 28_000, 30_000):
        for size in (limit - 1, limit, limit + 1):
            texts += ["q" * size, "q" * (size - 2) + ". ", "é" * size, "q" * (size // 2) + "\n\n" + "r" * (size - size // 2 - 2)]
    texts += ["🙂" * 900, "🙂. " * 4_000, "u" + "🙂" * 15_500, "v. " * 11_000, "\n\n".join(["s" * 700] * 90)]
    return texts


def random_texts():
    rng = random.Random(21)
    return [prose(rng, rng.choice([70, 900, 5_000, 33_000]), rng.choice([2, 6, 40])) for _ in range(60)]


def test_summary_chunks_equal_brute_force(column):
    texts = edge_texts() + random_texts() + [prose(random.Random(1), 95_000)]
    for text, got in zip(texts, column(summary_chunks, texts)):
        assert [(c.start_character, c.end_character, c.text) for c in got] == brute.summary_pieces(text), text[:60]


def test_summary_chunks_lose_no_word(column):
    texts = [prose(random.Random(i), 70_000 + 9_000 * i) for i in range(3)]
    for text, chunks in zip(texts, column(summary_chunks, texts)):
        assert "".join("".join(c.text.split()) for c in chunks) == "".join(text.split())
        assert len(chunks) >= 3 and all(c.end_character - c.start_character <= 30_000 for c in chunks)


def test_retrieval_chunks_equal_brute_force(column):
    texts = edge_texts() + random_texts() + ["t" * 990 + "? " + "n" * 240, "line. " * 80_000]
    got = column(retrieval_chunks, texts)
    for text, chunks in zip(texts, got):
        assert chunks == brute.retrieval_pieces(text), text[:60]
    # Nothing is cut off a long text unless a number of chunks is asked for.
    assert len(got[-1]) > 400
    assert column(lambda c: retrieval_chunks(c, 7), texts[-1:]) == [got[-1][:7]]


def test_sample_of_a_long_document(column):
    text = "".join(chr(0x61 + (i * 7) % 26) for i in range(9_000))
    gap = "\n\n[…]\n\n"
    want = text[:3000] + gap + text[3000:4500] + gap + text[7500:]
    assert column(document_sample, [text, "\tz ", "k" * 6000]) == [want, "z", "k" * 6000]
    assert column(lambda c: document_sample(c, 400), [text]) == [text[:200] + gap + text[4400:4500] + gap + text[-100:]]
