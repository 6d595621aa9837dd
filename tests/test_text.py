"""Text clean-up and in-row features on hand-made cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlens.functions import arrays as A
from postlens.functions import features as X
from postlens.functions import scores as E
from postlens.functions import text as T


def pre(ev, text, stops=None):
    return ev(lambda c: T.preprocess(c, stops), text)


@pytest.mark.parametrize("text, want", [
    ("Bobwrote: see n9005 @amy http://a.b/c at 3PM", "see at"),
    ("i am here pm", "here"),
    ("am am pm go", "go"),
    ("Café 世界", "cafe"),
    ("gagt123 hello gagtfoo there", "hello there"),
    ("path\\/to\nend", "path to end"),
    ("", ""),
    ("visit www.x.com/a_b?c=1, now", "visit now"),
    ("été ÉTÉ", "ete ete"),
])
def test_preprocess(ev, text, want):
    assert pre(ev, text) == want


def test_preprocess_order_of_fold(ev):
    # a separate accent splits a word, a precomposed one does not; ãm is no am
    assert pre(ev, "cafés ãm") == "cafe am"


def test_stop_words_keep_repeats(ev):
    assert pre(ev, "red the red fish", ["the"]) == "red red fish"


def test_tokens_are_clean_words(ev):
    rng = random.Random(1)
    alphabet = "aB1 _@:/.wé\n-amp世"
    for _ in range(30):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        got = ev(T.tokens, text)
        assert all(re.fullmatch(r"[a-z_]{2,}", w) for w in got)
        # cutting while splitting equals blanking in the text
        assert got == [w for w in ev(T.clean, text).split() if len(w) > 1]


def test_whitespace_split_matches_python(ev):
    text = "a b\x1cc d  e　​f"
    assert ev(T.whitespace_split, text) == text.split()


def test_value_counts(ev):
    words = "b a b c a b".split()
    got = ev(A.value_counts, words)
    assert {r["item"]: r["n"] for r in got} == Counter(words)
    placed = ev(A.value_counts_placed, words)
    assert {r["item"]: (r["n"], r["first"]) for r in placed} == {"b": (3, 0), "a": (2, 1), "c": (1, 3)}


def test_round_exact_is_printf(ev):
    rng = random.Random(2)
    values = [1 / 32, 0.00625, 0.00145, 0.28125, 0.5, 0.0, 2.5, 12345.00005] + [rng.random() * 50 for _ in range(50)]
    got = ev(lambda c: F.transform(c, lambda v: A.round_exact(v, 4)), values)
    assert got == [float("%.4f" % v) for v in values]


def test_ngrams(ev, feats):
    assert feats(lambda c: X.ngrams(c, 2, 2), "a b c d") == {"a b": 1, "b c": 1}
    assert feats(lambda c: X.ngrams(c, 2, 2, fixed=True), "a b c d") == {"a b": 1, "b c": 1, "c d": 1}
    assert feats(lambda c: X.ngrams(c, 1, 3), "One") == {}


def test_words(feats):
    got = feats(lambda c: X.words(c, stop_words=["the"]), "@bob #tag The dog, dog; soooo http://x.y/z café 99 ab")
    assert got == {"word_dog": 2, "word_caf": 1}
    got = feats(lambda c: X.words(c, max_features=2), "cat bat ant dog elk bat elk")
    assert got == {"word_bat": 2, "word_elk": 2}
    got = feats(lambda c: X.words(c, max_features=1), "xyz abc abc xyz")
    assert got == {"word_xyz": 2}


def test_emoticons(feats):
    assert feats(lambda c: X.emoticons(c, [":)", ":))", ":("]), "hi :)) ok :)") == {"emoticon_:)": 2, "emoticon_:))": 1}


def test_question_words(feats):
    got = feats(lambda c: X.five_w_one_h(c, "110000"), "Who is who? what [now]")
    assert got == {"who": 2 / 5, "what": 1 / 5, "dict_5w1h_avg": 3 / 5}
    assert feats(X.five_w_one_h, "!!! 123") == {}


def test_emotion_words_count_twice_in_two_categories(feats):
    lexicon = {"joy": ["glad", "warm"], "care": ["warm"], "fear": ["dread"]}
    got = feats(lambda c: X.emotion_words(c, lexicon), "warm glad warm Dread")
    assert got == {"joy": 3, "care": 2, "fear": 0, "emo_words_count": 5}


def test_polarity_is_strict(feats):
    lexicon = {"positive": {"exact": ["help"], "partial": ["lov"]}, "negative": {"exact": ["bad"]}}
    got = feats(lambda c: X.polarity_words(c, lexicon), "help help loving lov bad")
    assert got == {"lsd_positive_exact_help": 2, "lsd_positive_partial_lov": 1, "lsd_negative_exact_bad": 1}


def test_punctuation(feats):
    assert feats(X.punctuation, "hi !! yo !!")["num_punc_!!"] == 1
    fixed = feats(lambda c: X.punctuation(c, fixed=True), "hi !! yo !!")
    assert fixed == {"num_punc_!!": 2, "mean_num_punc_!!": 2 / 6}


def test_first_sentence_only(feats):
    assert feats(X.uppercase, "ABc. DEFG!") == {"mean_cap_words_per_sentence": 2, "max_cap_words_per_sentence": 2}
    assert feats(X.sentence_lengths, "ABc. DEFG!") == {"max_length": 4, "min_length": 4, "mean_length": 4, "std_length": 0}
    fixed = feats(lambda c: X.sentence_lengths(c, fixed=True), "ABc. DEFG!!")
    assert fixed == {"max_length": 6, "min_length": 4, "mean_length": 5, "std_length": 1}


def test_interrogatives(feats):
    got = feats(X.interrogatives, "Who knows whose? It is. Nowhere!")
    assert (got["num_who_sents"], got["num_whose_sents"], got["num_where_sents"]) == (2, 1, 1)
    assert got["num_interrogative_sents"] == 2 and got["pct_interrogative_sents"] == 0.6667


def test_repeated_chars(feats):
    assert feats(X.repeated_chars, "soooo coool") == {"o": 7}
    assert feats(lambda c: X.repeated_chars(c, single=False), "soooo") == {"oooo": 1}


def test_pos_tags(feats):
    got = feats(lambda c: X.pos_tags(c, {"DT": ["the"]}), "the dog. The the cat")
    assert got["DT"] == pytest.approx((1 / 3 + 2 / 3) / 2)
    assert got["NN"] == pytest.approx((2 / 3 + 1 / 3) / 2)


def test_blank_text_has_no_features(feats):
    for fn in (X.punctuation, X.uppercase, X.interrogatives, X.sentence_lengths, X.words, X.five_w_one_h):
        assert feats(fn, " \n ") == {} and feats(fn, "") == {}


def test_last_wins(ev):
    def pairs(c):
        first = F.transform(c, lambda w: F.struct(w.alias("feature"), F.lit(1.0).alias("value")))
        second = F.array(F.struct(F.lit("who").alias("feature"), F.lit(9.0).alias("value")))
        return X.merge(first, second)

    got = {r["feature"]: r["value"] for r in ev(pairs, ["who", "dog"])}
    assert got == {"who": 9.0, "dog": 1.0}


def test_entropy(ev):
    assert ev(lambda c: E.entropy_by_k(c, 2), [0.5, 0.5]) == 0.5
    assert ev(lambda c: E.entropy_normalized(c, 2), [0.5, 0.5]) == 1.0
    assert ev(lambda c: E.entropy_normalized(c, 1), [1.0]) is None
    assert ev(lambda c: E.entropy_by_k(c, 3), [1.0, 0.0, 0.0]) == 0
    assert [r["topic"] for r in ev(E.truncated, [0.004, 0.996])] == [1]
    assert ev(E.argmax, [0.2, 0.4, 0.4]) == 1
