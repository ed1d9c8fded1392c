"""Encoding, leaks, structure and spam of texts."""

import base64
import random
from pathlib import Path

import numpy as np
import pytest

from ravelin.llm import spam
from ravelin.llm.encoding import DEFAULT_VOCABULARY, Vocabulary, decode_corpus, encode_corpus
from ravelin.llm.leakage import PassageIndex, leak_spans, leaked_items, lower_in_place
from ravelin.llm.quality import not_prose, text_statistics
from ravelin.llm.spam import spam_pages, spam_share
from ravelin.llm.structure import read_texts

LONG = 300_000
needs_vocabulary = pytest.mark.skipif(not Path(DEFAULT_VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(Path(DEFAULT_VOCABULARY).read_bytes())


def texts(seed, n):
    r = random.Random(seed)
    signs = [chr(c) for c in range(0x20, 0x250)] + list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0   　᠎​́‍😀👩🏽東京한국العربيةहिन्दी'sIIll")
    signs += [chr(r.randrange(0x250, 0xD7FF)) for _ in range(200)] + [chr(r.randrange(0x10000, 0x1F9FF)) for _ in range(60)]
    return ["".join(r.choice(signs) if r.random() < 0.6 else r.choice("abcdeinst ") for _ in range(r.randrange(1, 60))) for _ in range(n)]


@needs_vocabulary
def test_encoder_equals_the_public_ones(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("tokenizers")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    first = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    second = tokenizers.Tokenizer.from_file(str(Path(DEFAULT_VOCABULARY).with_suffix(".json")))
    second.encode_special_tokens = True
    for t in [*texts(1, 3000), "<|endoftext|>", "the" * 500 + "!!" * 200, "ab" * 2000, "a" * 3000]:
        assert vocabulary.encode(t) == first.encode_ordinary(t) == second.encode(t, add_special_tokens=False).ids


@needs_vocabulary
def test_backtracking_equals_merging(vocabulary):
    r = random.Random(4)
    for _ in range(2000):
        piece = bytes(r.choice(b"aabcdehinorst\xc3\xa9\x00\xff") for _ in range(r.randrange(1, 25)))
        assert vocabulary.encode_piece(piece) == vocabulary.merged(piece)


def test_small_vocabulary_needs_backtracking():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"bcd": 258, b"aab": 259}
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
    v = Vocabulary(lines)
    for piece in (b"abcd", b"aabcd", b"aaabbcd", b"abab", b"bcdab" * 9):
        assert v.encode_piece(piece) == v.merged(piece)
    with pytest.raises(ValueError, match="lacks"):
        Vocabulary(lines.replace(base64.b64encode(b"a") + b" 97\n", b""))


@needs_vocabulary
def test_encoded_table(spark, vocabulary):
    some = [*texts(2, 200), "", None, " \t\n", "word " * LONG]
    rows = spark.createDataFrame([(i, t, [1], "b") for i, t in enumerate(some)], "doc_id long, text string, ids array<int>, body string")
    encoded = encode_corpus(rows)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert got == {i: vocabulary.encode(t or "") for i, t in enumerate(some)}
    assert {r.doc_id: r.text for r in decode_corpus(encoded).collect()} == {i: t or "" for i, t in enumerate(some)}
    assert encode_corpus(rows.limit(0)).count() == 0
    cut = spark.createDataFrame([(1, vocabulary.encode("é")[:1] if len(vocabulary.encode("é")) > 1 else [195]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in decode_corpus(cut).collect()} | {1: ""} == {1: "", 2: "", 3: ""}


ITEMS = "item_id long, text string, doc_id int, begin int"
DOCS = "doc_id long, text string, item_id int, words int"


def sentence(r, n):
    return [r.choice(["alpha", "beta", "gamma", "délta", "eps", "zeta", "x1", "2020"]) + str(r.randrange(50)) for _ in range(n)]


def words_of(t):
    return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()


def leaks(docs, items, n=12):
    grams = lambda t: {tuple(w[i : i + n]) for w in [words_of(t)] for i in range(len(w) - n + 1)}
    held = [(d, grams(t)) for d, t, *_ in docs if d is not None]
    return sorted((d, i) for d, g in held for i, t, *_ in items if i is not None and g & grams(t))


def leak_case(seed):
    r = random.Random(seed)
    items = [(i, " ".join(sentence(r, r.choice([5, 11, 12, 13, 40])))) for i in range(30)]
    items += [(40, items[3][1] + " " + items[4][1]), (41, None), (42, ""), (43, items[5][1].upper()), (None, items[6][1])]
    docs = []
    for d in range(80):
        w = sentence(r, r.randrange(0, 60))
        if r.random() < 0.6:
            source = r.choice(items)[1] or ""
            part = source.split()
            at = r.randrange(max(1, len(part) - 10))
            styles = [" ".join, lambda x: "\n".join(x).upper(), lambda x: " – ".join(x) + "!", lambda x: "(" + "), (".join(x) + ")"]
            w += [r.choice(styles)(part[at : at + r.choice([11, 12, 13, 40])])] + sentence(r, 5)
        docs.append((d, " ".join(w)))
    docs += [(90, None), (91, ""), (92, "filler " * LONG + " ".join(t for _, t in items[:3])), (93, docs[0][1]), (None, items[0][1])]
    return [(*d, 7, 8) for d in docs], [(*i, 7, 8) for i in items]


@pytest.mark.parametrize("seed", range(3))
def test_leaks(spark, seed):
    docs, items = leak_case(seed)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = leaks(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(d, i).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in leaked_items(d, i, items_per_block=7).collect()) == want
    text = {x[0]: x[1] for x in docs}
    for r in leak_spans(d, i).collect():
        found = words_of(text[r.doc_id][r.begin : r.end])
        item = words_of(dict((x[0], x[1]) for x in items)[r.item_id])
        assert len(found) == r.words >= 12
        assert any(item[k : k + len(found)] == found for k in range(len(item)))
        assert r.begin == 0 or not (text[r.doc_id][r.begin - 1].isalnum())


def test_leaks_of_empty_tables(spark):
    docs, items = leak_case(0)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert leaked_items(d.limit(0), i).count() == leaked_items(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_runs_are_the_longest_common_ones(n):
    r = random.Random(n)
    for _ in range(150):
        items = [(i, [r.choice("abc") for _ in range(r.randrange(0, 30))]) for i in range(3)]
        text = [r.choice("abcx") for _ in range(r.randrange(0, 40))]
        if items[0][1]:
            text += items[0][1][r.randrange(len(items[0][1])) :]
        want = set()
        for i, w in items:
            for a in range(len(text)):
                for b in range(len(w)):
                    if text[a] == w[b] and (a == 0 or b == 0 or text[a - 1] != w[b - 1]):
                        k = 0
                        while a + k < len(text) and b + k < len(w) and text[a + k] == w[b + k]:
                            k += 1
                        if k >= n:
                            want.add((i, a, a + k - 1))
        index = PassageIndex([(i, " ".join(w)) for i, w in items], n)
        assert index.hits(" ".join(text)) == sorted(want)


def test_passages_without_words():
    assert PassageIndex([(1, None), (2, "few words")]).hits("anything at all") == []
    assert lower_in_place("İΣA") == "iσa"


ENGLISH = """The harbour at the mouth of the river was built by the monks in 1240, and it was used by fishermen until the end of
the last century. When the railway came to the town, most of the trade moved to the larger port in the south, which had been
founded after the war."""
GERMAN = """Der Fluss ist im Winter oft gefroren, und die Leute der Stadt haben dann auf dem Eis einen Markt gehalten. Im Jahr 1790
wurde die Brücke durch den Sturm zerstört, aber sie ist nach dem Krieg wieder aufgebaut worden."""
FRENCH = """La ville fut fondée par les moines au début du siècle, et elle a été détruite pendant la guerre. On y trouve aussi une
église dont la tour n'a jamais été achevée, avec un jardin qui mène à la rivière."""
SPANISH = """La iglesia fue construida por el rey en el siglo doce y no ha sido cambiada desde la guerra. En la plaza hay una fuente
que se conoce por el agua fría, y cerca del puente está el mercado de los pueblos de la costa."""
PROSE = [ENGLISH, GERMAN, FRENCH, SPANISH, ENGLISH.upper(), ENGLISH.lower().replace(".", "").replace(",", ""), "\n".join(ENGLISH.split()), "  ".join(GERMAN.split())]
NAMES = [a + b for a in "Al Bor Car Da Far Gal Hol Jan Kel".split() for b in "ten gen den stad ford wick".split()]
NOUNS = "bridge mill tower church castle harbour market garden school river forest island lake road".split()
LISTS = [
    "\n".join(f"- {w} {NOUNS[i % 14]} of {NAMES[i]}" for i, w in enumerate("old new red stone iron high low broad".split() * 4)),
    "\n".join(f"{n} {NOUNS[i % 14]}, {i * 37 % 100}.{i}, {1900 + i}" for i, n in enumerate(NAMES)),
    "\n".join(f"{n}\t{i}\t{i * i}" for i, n in enumerate(NAMES)),
    "\n".join(f"the {NOUNS[i % 14]} of {n} ....... {i + 20}" for i, n in enumerate(NAMES)),
    "\n".join(f"{NOUNS[i % 14].title()} of {n}: {i}.{i}" for i, n in enumerate(NAMES)),
    "=-=-=- ~~~ {}[]|| <> " * 30,
    " ".join(f"{c}{i * 7919 % 97}qx{i}zk{c}" for i, c in enumerate("bcdfghjklm" * 12)),
    "\n".join(f"[{i}:40:19] WARN {n.upper()} code={i * 37} at 0x{i * 7919:x}" for i, n in enumerate(NAMES)),
]
SPAM = [
    "Buy cheap shoes online! Best shoes sale. Cheap shoes outlet, buy shoes, outlet sale. " * 12,
    "\n".join(f"https://www.shoes-{w}.example/{i}" for i, w in enumerate("sale buy cheap outlet".split() * 8)),
    "\n".join(f'<a href="http://{w}.shop.test/p{i}">shoes {w}</a>' for i, w in enumerate("sale buy cheap outlet".split() * 8)),
    "#shoes #sale #shoesSale #outlet #cheap " * 20,
    "\n".join(f"Alpha {w} {i} | size L | {i}.99 EUR | SKU {i}-100 | add to cart" for i, w in enumerate("shoes coat boots".split() * 9)),
    "Tags: shoes | outlet | shoes-sale | shoes | sale | outlet\n" * 12,
]


# Prose in languages whose function words the operators don't know.
OTHER_LANGUAGES = {
    "nl": """De haven werd in de twaalfde eeuw gebouwd door kooplieden uit het noorden, en lange tijd bleef zij de enige veilige
plaats tussen de twee rivieren. Toen de koning in 1384 de stad bezocht, gaf hij haar het recht om een markt te houden
op de eerste dag van elke maand. De meeste huizen bij het water gingen verloren in een brand die in een bakkerij
begon, maar de oude kerk werd niet beschadigd.""",
    "pl": """Port został zbudowany w dwunastym wieku przez kupców z północy i przez długi czas pozostawał jedynym bezpiecznym
miejscem między dwiema rzekami. Kiedy król odwiedził miasto w 1384 roku, nadał mu prawo do organizowania targu
pierwszego dnia każdego miesiąca. Większość domów nad wodą spłonęła w pożarze, który zaczął się w piekarni, ale stary
kościół nie został uszkodzony.""",
    "ru": """Гавань была построена в двенадцатом веке купцами с севера и долгое время оставалась единственным безопасным местом
между двумя реками. Когда король посетил город в 1384 году, он дал ему право проводить рынок в первый день каждого
месяца. Большинство домов у воды погибло в пожаре, который начался в пекарне, но старая церковь, стоящая на холме, не
пострадала.""",
    "pt": """O porto foi construído no século doze por mercadores do norte e durante muito tempo foi o único lugar seguro entre os
dois rios. Quando o rei visitou a cidade em 1384, deu-lhe o direito de realizar um mercado no primeiro dia de cada
mês. A maior parte das casas perto da água perdeu-se num incêndio que começou numa padaria, mas a velha igreja não foi
atingida.""",
    "it": """Il porto fu costruito nel dodicesimo secolo da mercanti del nord e per molto tempo rimase l'unico luogo sicuro tra i
due fiumi. Quando il re visitò la città nel 1384, le diede il diritto di tenere un mercato il primo giorno di ogni
mese. La maggior parte delle case vicino all'acqua andò perduta in un incendio che cominciò in un forno, ma la vecchia
chiesa non fu danneggiata.""",
    "sv": """Hamnen byggdes på tolvhundratalet av köpmän från norr, och under lång tid var den den enda säkra platsen mellan de två
floderna. När kungen besökte staden 1384 gav han den rätt att hålla marknad den första dagen i varje månad. De flesta
husen nära vattnet förstördes i en brand som började i ett bageri, men den gamla kyrkan skadades inte.""",
    "fi": """Satama rakennettiin kahdennellatoista vuosisadalla pohjoisesta tulleiden kauppiaiden toimesta, ja pitkään se oli ainoa
turvallinen paikka kahden joen välissä. Kun kuningas vieraili kaupungissa vuonna 1384, hän antoi sille oikeuden pitää
markkinoita jokaisen kuukauden ensimmäisenä päivänä. Useimmat veden lähellä olevat talot tuhoutuivat tulipalossa, joka
alkoi leipomosta, mutta vanha kirkko ei vahingoittunut.""",
    "tr": """Liman on ikinci yüzyılda kuzeyden gelen tüccarlar tarafından inşa edildi ve uzun süre iki nehir arasındaki tek güvenli
yer olarak kaldı. Kral 1384 yılında şehri ziyaret ettiğinde, ona her ayın ilk günü pazar kurma hakkı verdi. Suya yakın
evlerin çoğu bir fırında başlayan yangında yok oldu, ancak eski kilise zarar görmedi.""",
    "cs": """Přístav byl postaven ve dvanáctém století kupci ze severu a po dlouhou dobu zůstával jediným bezpečným místem mezi
oběma řekami. Když král v roce 1384 navštívil město, dal mu právo pořádat trh první den každého měsíce. Většina domů u
vody byla ztracena při požáru, který začal v pekárně, ale starý kostel poškozen nebyl.""",
    "el": """Το λιμάνι χτίστηκε τον δωδέκατο αιώνα από εμπόρους από τον βορρά και για πολύ καιρό παρέμεινε το μόνο ασφαλές μέρος
ανάμεσα στα δύο ποτάμια. Όταν ο βασιλιάς επισκέφθηκε την πόλη το 1384, της έδωσε το δικαίωμα να οργανώνει αγορά την
πρώτη μέρα κάθε μήνα. Τα περισσότερα σπίτια κοντά στο νερό χάθηκαν σε μια πυρκαγιά.""",
    "ar": """بني الميناء في القرن الثاني عشر على يد تجار من الشمال، وظل لفترة طويلة المكان الآمن الوحيد بين النهرين. وعندما زار
الملك المدينة في عام ١٣٨٤ منحها الحق في إقامة سوق في اليوم الأول من كل شهر. وقد ضاعت معظم المنازل القريبة من الماء في
حريق بدأ في مخبز.""",
}
DIALOGUE = """"Where did you put the keys?" she asked. "I left them on the table, next to the lamp." He looked again, but there was
nothing there. "Are you sure? I can't see them." "Of course I'm sure. You never look properly." They both laughed."""
# Structures that no sample has.
UNSEEN = [
    "\n".join(f"{n.upper()};{i};{i * i};{'yes' if i % 3 else 'no'};{n[::-1]}" for i, n in enumerate(NAMES)),
    "\n".join(f"§ {i}.{i % 7} {NOUNS[i % 14]} / {n}" for i, n in enumerate(NAMES)),
    "\n".join(f"{n} <{n.lower()}@mail.test>" for n in NAMES),
    "{" + ", ".join(f'"{n}": {{"x": {i}, "y": {i * 7}}}' for i, n in enumerate(NAMES)) + "}",
    "\n".join(f"{i % 12}.{i % 28}.19{i:02d} {n} - {NAMES[-i]} {i % 5}:{i % 4}" for i, n in enumerate(NAMES)),
    " ".join(f"%{i:02X}%{i * 3 % 256:02X}" for i in range(300)),
]


def shares(spark, some, column, f):
    rows = spark.createDataFrame([(i, t, t, 1, "w") for i, t in enumerate(some)], "doc_id long, body string, text string, chars int, words string")
    return {r.doc_id: r for r in f(rows).collect()}, rows


def test_prose_and_lists(spark):
    some = [p + "\n" + p for p in PROSE] + LISTS + SPAM
    _, rows = shares(spark, some, "body", text_statistics)
    cases = {r.doc_id for r in not_prose(text_statistics(rows)).collect()}
    assert cases == set(range(len(PROSE), len(some)))


def test_mixtures(spark):
    some = [ENGLISH + "\n\n" + GERMAN + "\n\n" + LISTS[0][:150], ENGLISH[:120] + "\n" + LISTS[1]]
    _, rows = shares(spark, some, "body", text_statistics)
    assert {r.doc_id for r in not_prose(text_statistics(rows)).collect()} == {1}


def test_statistics(spark):
    got, rows = shares(spark, ["One two.\nThree, four five!", None, "", " \n ", "| = |", "word " * LONG], "body", text_statistics)
    a = got[0]
    assert (a.chars, a.words, a.mean_word_length, a.symbol_ratio, a.line_end_ratio, a.common_word_ratio) == (26, 5, 19 / 5, 0.0, 1.0, 0.0)
    for i in (1, 2, 3):
        assert (got[i].words, got[i].mean_word_length, got[i].line_end_ratio, got[i].profile, got[i].other_share) == (0, None, None, None, 0.0)
    assert got[4].words == 0
    assert got[4].symbol_ratio == 1.0
    assert got[5].words == LONG
    assert {r.doc_id for r in not_prose(text_statistics(rows)).collect()} >= {5}
    assert text_statistics(rows.limit(0)).count() == 0


def test_spam_and_what_is_not(spark):
    some = [p + "\n" + p for p in PROSE] + LISTS + SPAM
    _, rows = shares(spark, some, "text", spam_share)
    assert {r.doc_id for r in spam_pages(spam_share(rows)).collect()} == set(range(len(PROSE) + len(LISTS), len(some)))


def test_other_languages_are_prose(spark):
    some = [*OTHER_LANGUAGES.values(), DIALOGUE, *(t.upper() for t in OTHER_LANGUAGES.values())]
    got, rows = shares(spark, some, "body", text_statistics)
    assert not_prose(text_statistics(rows)).count() == 0
    assert spam_pages(spam_share(rows)).count() == 0


def test_unseen_structures(spark):
    _, rows = shares(spark, [*UNSEEN, *OTHER_LANGUAGES.values()], "body", text_statistics)
    assert {r.doc_id for r in not_prose(text_statistics(rows)).collect()} == set(range(len(UNSEEN)))
    addresses = 2  # a list of addresses in which every name stands twice may count as a list of links
    assert {r.doc_id for r in spam_pages(spam_share(rows)).collect()} <= {addresses}


def test_perplexity_alone_decides(spark, monkeypatch):
    """Without an abnormal perplexity no text is spam, whatever it is made of; and the model is one of prose."""
    model = spam.ProseModel.of(spam.sample_counts())
    never = spam.ProseModel(np.full_like(model.bits, model.mean), model.mean)
    _, rows = shares(spark, SPAM + PROSE, "text", spam_share)
    assert spam_pages(spam_share(rows, model=never)).count() == 0
    assert {r.doc_id for r in spam_pages(spam_share(rows, model=model)).collect()} == set(range(len(SPAM)))


def test_model_does_not_learn_from_spam(spark):
    _, rows = shares(spark, SPAM * 3, "text", spam_share)
    np.testing.assert_array_equal(spam.fit(rows).bits, spam.ProseModel.of(spam.sample_counts()).bits)


def test_model_is_of_all_rows(spark):
    """Every row of prose counts, in a large table too, whatever its ``doc_id``."""
    times = 1_000
    rows = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(PROSE * times)], "doc_id long, text string")
    alone = [read_texts([t]) for t in PROSE]
    assert all(spam.of_prose(batch).all() for batch in alone)
    want = spam.sample_counts() + times * sum(spam.trigrams(batch) for batch in alone)
    np.testing.assert_array_equal(spam.fit(rows).bits, spam.ProseModel.of(want).bits)


def test_repeated_paragraphs_are_no_spam(spark):
    _, rows = shares(spark, [(ENGLISH + "\n") * 9, (GERMAN + "\n") * 9], "text", spam_share)
    assert spam_pages(spam_share(rows)).count() == 0


def test_articles_with_some_spam(spark):
    some = [ENGLISH + "\n\n" + FRENCH + "\n\n" + SPAM[1][:130], ENGLISH[:120] + "\n" + SPAM[0], SPAM[4] + "\n" + ENGLISH[:100]]
    _, rows = shares(spark, some, "text", spam_share)
    assert {r.doc_id for r in spam_pages(spam_share(rows)).collect()} == {1, 2}


def test_spam_of_odd_texts(spark):
    got, rows = shares(spark, [None, "", " ", "?", "buy shoes " * LONG], "text", spam_share)
    assert [(got[i].chars, got[i].perplexity, got[i].spam_share) for i in range(3)] == [(0, None, 0.0)] * 3
    assert got[4].spam_share == 1.0
    assert spam_share(rows.limit(0)).count() == 0


def test_segments_do_not_depend_on_company():
    alone = read_texts([LISTS[0]]).table()
    batch = read_texts([ENGLISH, LISTS[0], None, SPAM[0]])
    assert (batch.table()[batch.segment_doc == 1] == alone).all()
