import random

import numpy as np

from granary.llm import reading, scans

EASY = "The cow eats grass. The sun is warm. We go to the farm. The dog runs fast. "
HARD = (
    "Notwithstanding considerable methodological heterogeneity, contemporary agroecological investigations, which characteristically presuppose longitudinal instrumentation, "
    "substantiate the interdependence of mineralisation potentials, infiltration capacities and institutional preconditions; consequently, precautionary approaches differentiate. "
)


def test_trees_learn_and_cut(spark):
    rnd = random.Random(0)
    rows = []
    for i in range(120):
        k = i % 3
        body = "".join([EASY * 6, EASY * 3 + HARD, HARD * 4][k].split(" ")[0] + " " + x for x in [[EASY] * 5, [EASY, HARD, EASY, HARD], [HARD] * 4][k])
        rows.append((i, body, None, rnd.choice(["a", "b", None]), k + 1))
    df = spark.createDataFrame([(i, d, c, s, "x") for i, d, c, s, _ in rows], "rec_no long, description string, ko_content_flat string, ko_upload_source string, band string")
    panel = spark.createDataFrame([(i, "description", r, b) for i, _, _, _, b in rows[:90] for r in (1, 2, 3)], "rec_no long, field_name string, rater int, band int")
    got = {r.rec_no: r.band for r in reading.reading_levels(df, panel).collect()}
    assert np.mean([got[i] == b for i, *_, b in rows[90:]]) > 0.9
    assert reading.reading_levels(df.limit(0), panel).collect() == []
    assert {r.band for r in reading.reading_levels(df, panel.limit(0)).collect()} == {2}


def test_scope():
    assert reading.measure("Too short. Really.") is None
    assert reading.measure("no stops at all " * 40) is None
    assert reading.measure("") is None
    assert len(reading.measure(EASY * 10)) == len(reading.FEATURES)
    marked = "".join(f"<p class=\"a\">{EASY}</p>" for _ in range(10))
    assert reading.measure(marked)[1] == reading.measure(EASY * 10)[1]


def brute_candidates(word, words, confusions):
    """All words that ``word`` can have been, by trying every combination of up to so many confusions."""
    out, seen = {}, {(word, 0)}
    front = [("", word, 0)]
    while front:
        made, rest, used = front.pop()
        if not rest:
            if made in words:
                out[made] = min(out.get(made, 99), used)
            continue
        front.append((made + rest[0], rest[1:], used))
        if used < confusions:
            front += [(made + true, rest[len(read) :], used + 1) for read, true in scans.CONFUSIONS if rest.startswith(read)]
    del seen
    return out


def test_automaton_finds_every_candidate():
    words = {w: 100 for w in "modern clean dairy hill nine burn bum corn com learn the then clay day farm fann".split()}
    trie = scans.Trie(words)
    for word in ("modem", "clairy", "bum", "corn", "1earn", "hi11", "clay", "fann", "tbe"):
        assert {w: c for w, (_, c, _) in trie.candidates(word, 2).items()} == brute_candidates(word, words, 2), word


def test_plain_edits_are_complete():
    words = {w: 9 for w in "soil soils sail toil oil boil coil".split()}
    trie = scans.Trie(words)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for word in ("soil", "sol", "foil", "soill", "xyz"):
        assert {w for w, (e, _, _) in trie.candidates(word, 0, 1).items()} == {w for w in words if distance(word, w) <= 1}, word


LINES = [
    "The compost improves the leaf colour of the mountain", "zone in dry years, and the shepherd protects the yield near", "the river. The cooperative restores the grain quality along", "the slope because the mixture supports the soil cover."
]


def vocabulary():
    words = {w.strip(".,").lower(): 500 for line in LINES for w in line.split()} | {"modern": 400, "village": 300, "no-till": 100}
    return scans.Vocabulary(words, 3)


def test_kinds_of_noise():
    reader = scans.Reader(vocabulary())
    assert reader.find("\n".join(LINES)) == []
    assert reader.find("\n".join(LINES).replace("mountain\nzone", "moun-\ntain zone")) == ["hyphenation"]
    assert reader.find("\n".join([*LINES[:2], "- 12 -", *LINES[2:], "- 13 -"])) == ["page_number"]
    assert reader.find("\n".join(["Soil health", *LINES[:2], "Soil health", *LINES[2:]])) == ["running_header"]
    assert reader.find("\n".join(["Soil health", *LINES])) == []
    read = "\n".join(LINES).replace("compost", "cornpost").replace("shepherd", "sbepherd").replace("yield", "yie1d").replace("grain", "gram")
    assert reader.find(read) == ["misread"]
    assert reader.find("\n".join(LINES).replace("compost", "cornpost")) == []
    assert reader.repair(read) == " ".join(LINES)


def test_repair_reflows():
    reader = scans.Reader(vocabulary())
    text = "\n".join(["Soil health", *LINES[:1], "Page 3 of 9   Soil health", LINES[1].replace("shepherd", "shep-"), "herd " + LINES[2], LINES[3], "", *LINES, "Soil health"])
    text = text.replace("shep- protects", "protects")
    out = reader.repair("\n".join(["Soil health", LINES[0], "Soil health   Page 3 of 9", LINES[1], LINES[2], LINES[3], "", *LINES, "Soil health"]))
    assert out == " ".join(LINES) + "\n\n" + " ".join(LINES)
    assert "v i l l a g e" not in reader.repair(" ".join(LINES) + "\nThe v i l l a g e needs the soil.")
    assert reader.repair("") == ""


def test_noisy_edges(spark):
    body = "\n".join(LINES)
    rows = [(i, body, None) for i in range(30)] + [(50, "\n".join([*LINES[:2], "7", *LINES[2:], "8"]), ""), (51, None, None), (52, " ", "\n"), (53, body * 300, body), (50, "\n".join([*LINES[:2], "7", *LINES[2:], "8"]), "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rec_no long, description string, ko_content_flat string, noise string")
    got = [(r.rec_no, r.field_name, r.noise) for r in scans.noisy(df).collect()]
    assert got == [(50, "description", "page_number")] * 2
    fixed = {(r.rec_no, r.field_name): r.clean_text for r in scans.repair(df).collect()}
    assert fixed[50, "description"] == " ".join(LINES) and (51, "description") not in fixed and len(fixed[53, "description"]) > 50_000
    assert scans.noisy(df.limit(0)).collect() == []


def test_plain_edits_explain_words_below_the_floor():
    """No confusion makes "shepkerd" or "co6post"; one edit does, and the text around decides."""
    reader = scans.Reader(vocabulary())
    text = "\n".join(LINES)
    assert not any(reader.speller.printed(w) for w in ("shepkerd", "rmxture", "co6post"))
    assert [w for w, _ in reader.speller.near("shepkerd")] == ["shepherd"] and reader.speller.near("soils") == reader.speller.near("shepherds") == ()
    read = text.replace("compost", "co6post").replace("grain", "gram")
    assert reader.repair(read) == " ".join(LINES)
    # Letters alone need a witness: other misread words and the printed word elsewhere.
    once = text.replace("shepherd", "shepkerd")
    assert "shepkerd" in reader.repair(once) and "shepkerd" in reader.repair(once.replace("grain", "gram"))
    assert "shepkerd" not in reader.repair((once + "\n" + text).replace("grain", "gram"))
    assert reader.find(text.replace("compost", "co6post").replace("yield", "y7eld").replace("slope", "s6ope")) == ["misread"]


def test_neighbouring_words_decide():
    """Two plain edits, or one without another witness, count where the corpus has the printed word between the same neighbours."""
    import numpy as np

    words = vocabulary().words
    pairs, cells = np.zeros(1 << 16, np.int64), scans.Pairs(1 << 16)
    np.add.at(pairs, cells.cells([w.strip(".,").lower() for line in LINES for w in line.split()] * 40), 1)
    reader, blind = scans.Reader(scans.Vocabulary(words, 3, pairs)), scans.Reader(vocabulary())
    text = "\n".join(LINES).replace("grain", "gram")
    for read in ("cooqezative", "coope4atlve", "coopeqative"):
        assert reader.repair(text.replace("cooperative", read)) == " ".join(LINES), read
    assert "cooqezative" in blind.repair(text.replace("cooperative", "cooqezative"))
    # A name in capitals, or other neighbours, stay.
    assert "Cooqezative" in reader.repair(text.replace("cooperative", "Cooqezative"))
    assert "cooqezative" in reader.repair(text + "\nzone cooqezative slope")
    assert reader.beside("the", "compost") == 0 or reader.beside("the", "compost") > reader.beside("compost", "the")


def test_a_repeated_start_of_a_sentence_is_no_heading():
    lines = ["The phytosanitary monitoring", "improves the leaf colour of the mountain zone in dry years.", "The phytosanitary monitoring", "restores the grain quality along the slope of the region."]
    assert scans.Reader(vocabulary()).find("\n".join(lines)) == []
