import datetime

import pytest

from millrace.llm.endings import train_endings
from millrace.llm.languages import other_language, script
from millrace.llm.pairs import broken_pairs, defect, fit_endings, is_copy, is_empty
from millrace.llm.refusals import is_refusal
from millrace.llm.structure import dangling, open_constructs, tiles

SUBJECTS = ["the night crew", "the main tank", "a worn seal", "the lead nurse", "our field team"]
VERBS = ["checks", "moves", "cools", "reports", "replaces"]
OBJECTS = ["the red valve", "the old filter", "the drug label", "the cover plate", "the host list"]
ENDS = ["", " once a week", " at the end of each shift", " in cold rooms", " before the door is shut"]


def answers():
    return [f"{s[0].upper()}{s[1:]} {v} {o}{e}. In short, {s} {v} {o}." for s in SUBJECTS for v in VERBS for o in OBJECTS for e in ENDS]


@pytest.fixture(scope="module")
def model():
    return train_endings(answers())


@pytest.mark.parametrize("text", [None, "", "  ", "​", "\xa0", "n/a", "N/A", "TBD", "-", "—", "...", "None", "null", "{}", "[]", '""', "```json\n```", "<empty>", "(no answer)", "Answer:", "<p> </p>", "?"])
def test_empty(text):
    assert is_empty(text)


@pytest.mark.parametrize("text", ["No.", "Nie.", "7", "Section 4", "the", "Non", "Never."])
def test_not_empty(text):
    assert not is_empty(text)


@pytest.mark.parametrize("answer", ["How does the night crew move the tank?", "HOW DOES THE NIGHT CREW MOVE THE TANK?", "how does the night crew move the tank", "Q: How does the night crew move the tank?", "Does the night crew move the tank how.", "How does the nigt crew move the tank?", "How does the night crew move the tank? How does the night crew move the tank?", "> How does the night crew move the tank?", "How does thenight crew move the tank?"])
def test_copies(answer):
    assert is_copy("How does the night crew move the tank?", answer)


@pytest.mark.parametrize("answer", ["How does the night crew move the tank? With a cart, once a week, near the rack.", "The night crew moves the tank with a cart.", "With a cart.", "No."])
def test_no_copies(answer):
    assert not is_copy("How does the night crew move the tank?", answer)


REFUSALS = [
    "I cannot share details about the valve. Please ask a qualified person.", "I’m sorry, but I can’t help with that.", "As an AI system, I don't have an opinion on this.", "THE PROVIDED CONTEXT DOES NOT CONTAIN ENOUGH INFORMATION TO ANSWER.",
    "I'm afraid I'm not able to answer that.", "I would rather not answer this question.", "The documents say nothing about the valve.", "Hmm. I don't know.", "We are unable to provide an answer.",
    "No information on this is available in the documents.", "It is not possible to answer this from the given text.", "The answer cannot be found in the provided passages.", "I was not able to find an answer in the sources.",
    "Das weiß ich nicht.", "No lo sé.", "Lamento no poder responder.", "Me temo que no puedo contestar.", "Il m'est impossible de répondre à cette question.", "Ich möchte mich dazu nicht äußern.",
    "Leider kann ich diese Frage nicht beantworten.", "Dazu darf ich keine Auskunft geben.", "Der Kontext enthält keine Angaben dazu.",
    "Je ne peux pas répondre à cette question.", "Je préfère ne pas me prononcer sur ce sujet.", "Désolé, cela sort de ce que je peux traiter.",
    "Lo siento, no puedo responder a esa pregunta.", "Prefiero no opinar sobre este asunto.", "El texto no contiene información suficiente para responder.",
]
ANSWERS = [
    "Staff must decline any request for the old filter that lacks a signature.", "You are unable to log in while the night crew stops the tank; wait 5 minutes and try again.", "It is not allowed to open the valve once a week, so call the shift lead first.",
    'If the form says "insufficient information", the main tank stops.', "Sorry to say, the cold store was moved last year: the help desk holds it now.", "The operator cannot restart the tank until the seal holds.", "No, because the crew stops it.",
    "The pump cannot start until the seal holds.", "No details are needed for the daily plan.", "The document lists the spare parts and does not change.", "I check the valve once a week.", "Der Tank darf nicht geöffnet werden.",
    "Le relais ne peut pas ouvrir la vanne.", "El tanque no puede abrir la válvula.", "No se cambia el filtro.",
    "Ohne Freigabe darf niemand das Ventil öffnen, denn die Sperre hält den Tank.", "On ne peut pas ouvrir la vanne tant que le relais teste le capot.", "No se puede abrir la tapa hasta que el tanque guarda la cuenta.", "No.", "Never.",
]


def test_refusals():
    assert [t for t in REFUSALS if not is_refusal(t)] == []
    assert [t for t in ANSWERS if is_refusal(t)] == []


def test_languages():
    q = "What happens when the main tank cools the red valve?"
    for other in ["Der Kundendienst prüft das Ventil nach der Schicht.", "Le relais vérifie le capot dans la salle.", "El tanque enfría la cuenta con la tapa.", "Il modulo ferma la valvola alla fine del turno.", "Het koelhuis stopt het oude filter na de dienst.", "Moduł zatrzymuje zawór na koniec zmiany bez zwłoki, bo nie jest gotowy.", "Клапан закрывается ночью."]:
        assert other_language(q, other)
    for same in ["The tank stops.", "20 bar", "No.", "Section 7", "- the red valve\n- the old filter", "Umevel-L2"]:
        assert not other_language(q, same)
    assert script("123") is None and script("日本の") == "CJK"


def test_pushdown():
    assert open_constructs("a (b [c] d) 1) x") == []
    assert open_constructs("a (b [c") == ["(", "["]
    assert open_constructs('he said "stop') == ['"']
    assert open_constructs("„zu“ «a» “b”") == []
    assert open_constructs("```py\nprint('(')\n```") == [] and open_constructs("```py\nx = (1") == ["```"]
    assert open_constructs("<b>x</b><br><i>y") == ["<i"]
    assert dangling("1. Do this.\n2. Do that.\n3. ") and dangling("1. Do this.\n2.") and not dangling("1. Do this.\n2. Do that.")
    assert not dangling("The number is 3.")


def test_tiles_are_maximal():
    assert tiles("a b c d e".split(), "c d e a b".split()) == (5, 2)
    assert tiles("a a a".split(), "a".split()) == (1, 1)
    assert tiles([], ["a"]) == (0, 0)


def test_truncation(model):
    q = "What does the crew do?"
    for cut in ["The night crew checks the", "The night crew checks the red valve before the door", "A worn seal moves the old fil", "The main tank cools the host list (", "The night crew moves the red valve,", "The lead nurse checks the red valve: \"the main tank", "1. The night crew checks it.\n2. "]:
        assert defect(q, cut, model) == "truncated", cut
    for whole in ["The night crew checks the red valve", "The night crew checks the red valve once a week", "- the red valve\n- the old filter", "20 bar", "Section 77", "Twice a day", "The night crew checks the red valve (see section 4)", "Yes.", "The night crew checks the red valve – ok"]:
        assert defect(q, whole, model) is None, whole


def test_frame(spark, model):
    t = datetime.datetime(2025, 1, 1)
    schema = "triple_id long, created_at timestamp, question string, answer string, follow_up_q string, follow_up_a string, field string, defect string"
    row = lambda i, q, a, fq=None, fa=None, h=0: (i, t + datetime.timedelta(hours=h), q, a, fq, fa, "clash", "clash")
    rows = [
        row(1, "What is it?", None), row(2, "What is it?", "It is the red valve.", "And then?", "n/a"), row(3, None, "TBD", " ", "TBD"), row(4, "What is it?", "I don't know.", "", None),
        row(5, "Who is it?", "", h=1), row(5, "Who is it?", "It is the lead nurse.", h=2), row(6, "Who checks the red valve?", "Who checks the red valve?"), row(None, "x", None),
        row(7, "What is it?", "The main tank cools the host list. " * 3000), row(8, "What is it?", "The valve " * 20000 + "(", None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.triple_id, r.field, r.defect) for r in broken_pairs(df.unionByName(df), model).collect()}
    assert got == {(1, "answer", "empty"), (2, "follow_up_a", "empty"), (3, "answer", "empty"), (4, "answer", "refusal"), (6, "answer", "copy"), (8, "answer", "truncated")}
    assert broken_pairs(df.limit(0), fit_endings(df.limit(0))).count() == 0


def test_words_are_counted_over_all_texts(spark):
    letters = "abcdefghij"
    rare = [f"zo{a}{b}k" for a in letters for b in letters]
    schema = "triple_id long, answer string, follow_up_a string"
    rows = [(k, f"The crew checks the {rare[k % 100]} and the valve.", None if k % 2 else f"It is the {rare[k % 100]}x that they have.") for k in range(300)]
    model = fit_endings(spark.createDataFrame(rows, schema), max_texts=20)
    assert set(rare) <= model.known and {model.lexicon.get(w) for w in rare} == {"en"}
    assert {f"{rare[k]}x" for k in range(0, 100, 2)} <= model.known
    once = fit_endings(spark.createDataFrame(rows[:100], schema), max_texts=20)
    assert not set(rare) & once.known


# Wordings set down once, from no grammar and no table; the grammars are not to be fitted to them.
HELD_OUT = {
    "en": [
        "I regret that this falls outside what I am able to discuss.", "That is something I must leave unanswered.", "The excerpts give no indication, so I will not speculate.",
        "I'm unable to give you a reliable reply here.", "We do not have the details needed to respond.", "My apologies, but I can't assist with this one.", "It would be irresponsible of me to answer.",
        "There is not enough in the passage for me to tell.", "I have to pass on this question.", "The document doesn't say.", "I do not possess that knowledge.", "Please understand that I cannot go further into this.",
    ],
    "de": [
        "Dazu kann ich Ihnen leider nichts sagen.", "Diese Frage möchte ich nicht beantworten.", "Aus den vorliegenden Unterlagen geht das nicht hervor.", "Ich bin nicht befugt, darüber Auskunft zu geben.",
        "Hierzu fehlen mir die nötigen Angaben.", "Das weiß ich nicht.", "Der Text enthält keine Angaben dazu.", "Leider ist mir das nicht bekannt.",
    ],
    "fr": [
        "Je ne suis pas en mesure de vous répondre.", "Je regrette, mais je ne peux rien dire à ce sujet.", "Le document ne fournit aucune précision.", "Je n'ai pas connaissance de cette information.",
        "Il m'est impossible de me prononcer.", "Désolé, cela dépasse mes compétences.", "Je préfère ne pas répondre.", "Les extraits ne permettent pas de conclure.",
    ],
    "es": [
        "No estoy en condiciones de responder a eso.", "Lamento no poder darle una respuesta.", "El documento no lo menciona.", "No dispongo de esos datos.", "Prefiero no opinar sobre ese asunto.",
        "Eso queda fuera de mi ámbito.", "No me es posible contestar.", "Los fragmentos no contienen esa información.",
    ],
}
#: Answers that look a little like refusals.
NOT_REFUSALS = [
    "No, visitors may not enter the ward without a badge.", "The device cannot be opened while it is hot.", "Employees who are unable to attend must inform the supervisor by noon.", "Not before the seal has been checked.",
    "Ohne Ausweis darf niemand das Lager betreten.", "Nein, die Frist kann nicht verlängert werden.", "Le service ne rembourse pas les frais de port.", "No se puede cancelar después del lunes.", "You should decline the offer in writing within ten days.",
]


def test_refusals_held_out_by_wording():
    from millrace.llm.refusals import is_refusal

    said = [t for ts in HELD_OUT.values() for t in ts]
    missed = [t for t in said if not is_refusal(t)]
    wrong = [t for t in NOT_REFUSALS if is_refusal(t)]
    assert len(missed) <= 0.3 * len(said), missed  # 10 of 36 when first measured
    assert len(wrong) <= 1, wrong


def test_a_question_given_back_any_number_of_times():
    asked = "What is the limit for oxygen in the east wing?"
    for times in (1, 2, 4, 5, 6, 40):
        assert is_copy(asked, " ".join([asked] * times))
    assert is_copy(asked, " ".join([asked] * 7).replace("oxygen", "oxigen", 1))
    assert not is_copy(asked, asked + " The limit is twelve litres an hour in the east wing, says the manual of the house.")
    assert not is_copy(asked, " ".join([asked] * 5) + " It is twelve litres an hour, by the manual, and is checked each morning by the nurse on duty there.")
