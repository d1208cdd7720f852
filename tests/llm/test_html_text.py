import itertools

import numpy as np

from sievework.llm import html_text as H

PAGES = "page_id long, url string, html string, text int, n_chars string"


def test_held_out_pages():
    field, right, n = H.trained(), 0, 0
    for page in H.labelled_pages(80, seed=123):
        told = field.viterbi(page)
        right += sum(a == b[-1] for a, b in zip(told, page, strict=True))
        n += len(page)
    assert right / n > 0.98


def test_pages(spark):
    page = (
        "<html><head><title>No</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>"
        '<!-- <p>hidden</p> --><div class="ad">Buy &amp; go now please.</div><article><h1>A &lt;title&gt;</h1><p><b>One.<br><p>Two  &eacute;\n three.</p>'
        '<div class="comments"><div class="comment"><p>I disagree with this.</p></div></div></article><footer>&copy; x.example &middot; rights.</footer>'
    )
    rows = [(1, "u", page, 1, ""), (2, None, None, 1, ""), (3, "v", "", 1, ""), (4, "w", page[:-40] + "<p", 1, ""), (None, "z", "<article><p>" + "word " * 50_000 + "</p></article>", 1, ""), (1, "u", page, 1, "")]
    got = sorted(H.extract(spark.createDataFrame(rows, PAGES), H.trained()).collect(), key=lambda r: str(r.page_id))
    assert [r.text for r in got[:3]] == ["A <title>\n\nOne.\n\nTwo é three."] * 2 + [""]
    assert all(r.n_chars == len(r.text) for r in got) and got[3].text == "" and got[4].text.startswith("A <title>") and len(got[5].text) == 249_999
    assert H.extract(spark.createDataFrame([], PAGES), H.trained()).collect() == []


def small_field(rnd):
    """A field with random weights over the features of one composed page."""
    page = next(p for p in H.labelled_pages(30, seed=9) if 5 <= len(p) <= 9)
    field = H.Field()
    for f in sorted({f for a, t, s, _ in page for f in H.place_features(a) | set(H.text_features(t, s))}):
        field.index[f] = len(field.index)
    field.w, field.start, field.step = rnd.standard_normal((len(field.index), 2)), rnd.standard_normal(2), rnd.standard_normal((2, 2))
    return field, page


def total(field, e, labels):
    return field.start[labels[0]] + sum(e[i][y] for i, y in enumerate(labels)) + sum(field.step[a][b] for a, b in itertools.pairwise(labels))


def test_decoding_equals_enumeration():
    rnd = np.random.default_rng(4)
    for _ in range(25):
        field, page = small_field(rnd)
        e = field.emissions(page)
        best = max(itertools.product((0, 1), repeat=len(page)), key=lambda y: total(field, e, y))
        assert field.viterbi(page) == list(best)


def test_one_step_of_training_follows_the_likelihood():
    """The gradient by forward and backward sums equals that of the enumerated log-likelihood: Adagrad's first step has its sign."""
    field, page = small_field(np.random.default_rng(5))
    y = [b[-1] for b in page]

    def likelihood(f):
        e = f.emissions(page)
        z = [total(f, e, labels) for labels in itertools.product((0, 1), repeat=len(page))]
        return total(f, e, y) - (max(z) + np.log(np.sum(np.exp(np.array(z) - max(z)))))

    trained = H.Field().fit([page], rounds=1, rate=1e-4, decay=0.0)
    zero = H.Field()
    zero.index, zero.w = trained.index, np.zeros_like(trained.w)
    before = likelihood(zero)
    for k in range(2):
        for step in (zero.start, zero.step[k]):
            own = trained.start if step is zero.start else trained.step[k]
            for i in range(2):
                step[i] += 1e-5
                slope = (likelihood(zero) - before) / 1e-5
                step[i] -= 1e-5
                # One step: rate * g / sqrt(0.01 + g * g).
                assert abs(own[i] - 1e-4 * slope / np.sqrt(0.01 + slope * slope)) < 2e-7
