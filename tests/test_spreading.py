"""Songs are dealt over all partitions, even where they come partitioned by song, and windows of phrases equal a plain search."""

from difflib import SequenceMatcher

import pytest

from melisma.operators import phrases, quantization, words


@pytest.mark.parametrize("module, name", [(phrases, "phrase_windows"), (phrases, "ordered_phrase_windows"), (phrases, "ordered_lines"), (words, "manual_windows"), (quantization, "placed_onsets")])
def test_songs_are_dealt_out(spark, sf_dir, module, name):
    assert module.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_letters_in_common_lose_no_window():
    text, phrase = "天地人你我天他人好春地天人夏天地秋人你", "天地人你我"
    found = []
    for start in range(len(text)):
        for length in range(3, 9):
            m = SequenceMatcher(None, phrase, text[start : start + length], autojunk=False)
            blocks = [b for b in m.get_matching_blocks() if b.size >= phrases.RUN]
            if start + length <= len(text) and m.ratio() >= phrases.LIKE and blocks:
                found.append((start, length, m.ratio(), blocks))
    heard = phrases.Heard(text)
    assert len(found) > 5 and heard.windows(phrase) == found
    assert len(heard.known) < 40  # 81 windows; those with too few letters in common are not compared
