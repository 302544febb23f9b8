import pytest

from folioscope.operators import chunking as ch


def test_headings_and_fence():
    fence = "```go\n" + "\n".join(f"line {i}\n" if i == 5 else f"line {i}" for i in range(40)) + "\n```"
    text = f"# Top\n\nintro words\n\n## Part\n\nbefore\n\n{fence}\n\nafter the fence\n"
    chunks = ch.split_markdown(text, 35, 8)
    assert [c["index"] for c in chunks] == list(range(len(chunks)))
    assert sum(fence in c["markdown"] for c in chunks) == 1
    assert chunks[-1]["heading_path"] == ["Top", "Part"]


def test_oversized_prose_keeps_heading():
    text = "# One\n\n" + " ".join(f"word{i}" for i in range(200))
    chunks = ch.split_markdown(text, 20, 3)
    assert len(chunks) >= 3 and all(c["heading_path"] == ["One"] for c in chunks)


def test_sizes():
    for bad in ((10, 10), (10, -1), (None, 800)):
        with pytest.raises(ValueError):
            ch.check_sizes(*bad)
    assert ch.check_sizes(None, None) == (800, 100)
    assert ch.check_sizes(50, 0) == (50, 100)


def test_block_rules():
    assert ch.blocks("### deep\ntext\n\n# up\r\nmore") == [("### deep\ntext", ["", "", "deep"]), ("# up\nmore", ["up"])]
    assert ch.blocks(" # indented\n\n## closed ##") == [("# indented", []), ("## closed ##", ["", "closed ##"])]
    assert ch.blocks("```\na\n\n# not\n~~~\n\n# yes") == [("```\na\n\n# not\n~~~", []), ("# yes", ["yes"])]
    assert ch.blocks("~~~\n\nnever closed\n\n# x") == [("~~~\n\nnever closed\n\n# x", [])]
    assert ch.blocks("") == ch.blocks(" \n\t\n") == []


def test_giant_word_and_overlap_beyond_max():
    chunks = ch.split_markdown("x" * 400 + " y", 20, 5)
    assert "x" * 400 in chunks[0]["markdown"]
    long = " ".join(["abcdefg"] * 300)  # blocks of nearly 20 tokens: each chunk but the first carries a whole one
    sizes = [ch.estimate(c["markdown"]) for c in ch.split_markdown(long, 20, 5)]
    assert max(sizes) > 20


def test_pack_matches_a_plain_walk():
    import random

    def walk(sizes, limit, overlap):
        out, current, start = [], [], 0
        for i, s in enumerate(sizes):
            if current and sum(sizes[j] for j in current) + s > limit:
                out.append((current[0], current[-1] + 1))
                kept = []
                for j in reversed(current):
                    if sum(sizes[k] for k in kept) >= overlap:
                        break
                    kept.insert(0, j)
                current = kept
            current.append(i)
            if s > limit:
                out.append((current[0], i + 1))
                current = []
        if current:
            out.append((current[0], current[-1] + 1))
        return out

    for seed in range(300):
        r = random.Random(seed)
        sizes = [r.randint(1, 14) for _ in range(r.randint(0, 30))]
        limit = r.randint(2, 12)
        overlap = r.randint(1, limit - 1)
        assert ch.pack(sizes, limit, overlap) == walk(sizes, limit, overlap)


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "# A\n\nb", "z"), (2, None, "z"), (3, "  ", "z")], "id int, text string, _chunks string")
    rows = ch.chunk_documents(df, ["id"], "text").collect()
    assert [tuple(r) for r in rows] == [(1, 0, ["A"], "# A\n\nb\n")]
