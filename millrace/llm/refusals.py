"""Grammars of refusals in four languages: somebody who answers says that he can't or won't."""

from __future__ import annotations

import re

_APOS = str.maketrans({"’": "'", "‘": "'", "ʼ": "'", "´": "'"})
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")

_SPEAK = r"(answer|respond|reply|help|assist|comment|discuss|share|provide|tell|say|speak|talk|give|offer|disclose|advise|comply|explain|go into|weigh in|determine|confirm|engage)"
_SOURCE = r"(context|passages?|excerpts?|texts?|documents?|material|sources?|files?|information|data|extracts?|content|snippets?)"
#: Each grammar is matched inside one sentence, quotations taken out, letter case ignored.
GRAMMARS = {
    "en": [
        rf"\b(i|we)( am| are|'m|'re)?\s+(really |simply |just |also |truly |currently )?(can ?not|can't|could ?n[o']t|couldn't|unable to|not able to|won't|will not|would not|wouldn't|must not|may not|must decline|have to decline|decline|refuse|would rather not|do not wish|don't wish|prefer not|'d rather not|would prefer not)\b.*?\b({_SPEAK}|able|do that|do this)\b",
        r"\b(i|we)( must| have to| need to| will|'ll)? (respectfully |politely )?(decline|refuse|abstain|pass on)\b",
        r"\b(i|we)('d| would| will|'ll)? (much )?rather not\b",
        r"\b(i|we) (do not|don't|did not|didn't|can't|cannot|can not) (really )?(know|recall|have (an|any|the|enough|sufficient|access)|see|find|hold (an|any))\b",
        r"\bi('m| am) (not (sure|certain|allowed|permitted|authori[sz]ed|in a position|qualified|able|aware|comfortable)|unable|afraid)\b",
        r"\bi have (no|insufficient|nothing|not enough)\b|\bi lack\b|\bi'd (only )?be guessing\b|\bnothing i have\b",
        rf"\bnot (something|a (topic|subject|question|matter)) (that )?(i|we)\b|\bwhat (i am|i'm|we are) (allowed|permitted|able) to {_SPEAK}\b|\b(beyond|outside)( of)? (my|our|what i)\b",
        r"\bmy (usage |content |safety )?(guidelines?|polic(y|ies)|instructions|rules|training|programming|knowledge)\b|\bagainst (my|our) (usage )?(policy|policies|rules|guidelines)\b",
        r"\bas an? (ai|artificial|language model|assistant|automated)\b",
        r"\bnot be (appropriate|right|proper|responsible) for (me|us)\b|\badvice (i'm|i am) not\b",
        rf"^(there is |there's |with )?(insufficient|not enough|too little|inadequate|no) ({_SOURCE}|detail)\b.*?\b({_SPEAK}|for me|unable)\b|^(insufficient|not enough) {_SOURCE}\b",
        rf"\b{_SOURCE}\b[^.]*\b(do(es)? not|doesn't|don't|lacks?|fails? to|is silent|are silent|says? nothing|has no|have no)\b.*?\b(contain|include|cover|mention|say|enough|information|details?|answer|on|about|address|provide|state|specify)\b",
        rf"\bno (answer|reply|response) (can|could|may) be (given|found|derived|provided)\b|\bnothing in the {_SOURCE}\b|\bno answer (is )?possible\b",
        r"^let('s| us) (talk|speak|discuss|move|change)\b.*\b(else|another|different|subject|topic)\b|\btry another (topic|question)\b",
        r"\b(cannot|can't|can not|unable to) be (answered|determined from)\b|\bunable to (comply|answer|assist|help|respond|provide)\b(?=.*\b(request|question|this|that|context)\b|[.!]?$)",
        r"^(i'm |i am |we are |we're )?(so |very |really )?(sorry|apologies|apologise|apologize|regret)\b.*\b(i|we|me)\b.*\b(can't|cannot|not|no way|unable|unfortunately|rather)\b",
        r"^(unfortunately|regrettably|sadly),? (i|we) (can|am|must|do|have|will|may)\b",
        r"\bno (information|details?|data|mention|answers?)\b.*\b(available|given|provided|found|included|contained)\b",
        rf"\b(not |im)possible to {_SPEAK}\b|\b(answer|this|that|it) (cannot|can't|could not|couldn't|can not) be (found|answered|determined|given|derived|inferred)\b",
        rf"\bi (was|am|have been) (not able|unable) to (find|{_SPEAK[1:-1]})\b",
    ],
    "de": [
        r"\b(ich|wir)\b.*\b(kann|können|darf|dürfen|möchte|möchten|will|wollen|werde|vermag|könnte)\b.*\b(nicht|keine?n?|nichts)\b",
        r"\b(kann|können|darf|dürfen|möchte|möchten|will|werde)\b.*\b(ich|wir)\b.*\b(nicht|keine?n?|nichts)\b",
        r"\b(dabei|damit|dazu|darüber|hierzu|dafür|leider) (kann|darf|möchte|will) ich\b.*\b(nicht|keine?)\b",
        r"\b(weiß|weiss) ich (leider |es )?nicht\b",
        r"\bich (weiß|weiss) (es |das |darauf )?(leider )?(nicht|keine)\b|\b(mir|uns) (liegen|liegt|fehlen|fehlt|ist|sind)\b.*\b(keine?|nicht|angaben|informationen|nähere)\b|\b(liegen|liegt) (mir|uns)\b.*\bkeine?\b",
        r"\b(lässt|lassen) sich\b.*\b(keine?|nicht) (antwort|aussage|beantworten|ableiten|auskunft)?\b.*\b(antwort|ableiten|beantworten|entnehmen|aussage)\b|\b(keine?) (antwort|auskunft|aussage|stellungnahme) (möglich|ableiten|geben)\b",
        r"\b(text|kontext|unterlagen|auszüge|dokumente?|angaben|informationen|passagen|quellen)\b.*\b(nicht aus|reichen nicht|keine (antwort|angaben|auskunft|information)|enthalten? (keine|nicht|dazu nichts)|unzureichend)\b",
        r"\bals (ki|künstliche|sprachmodell|assistent)\b|\b(meine|meinen|unsere) (richtlinien|vorgaben|regeln|nutzungsrichtlinien)\b|\blehne (ich )?.*\bab\b|\bich muss ablehnen\b|\bdarüber spreche ich nicht\b|\b(lass|lassen sie) uns\b.*\b(anderes|thema)\b",
        r"^(es )?tut mir leid\b.*\b(nicht|keine?)\b|^(leider|entschuldigung)\b.*\b(ich|mir|uns|wir)\b.*\b(nicht|keine?)\b|\b(übersteigt|außerhalb) (meine|meiner|dessen)\b",
    ],
    "fr": [
        r"\b(je|nous|j')\s?(ne |n'|regrette)?.*\b(peux|puis|suis|peut|pouvons|souhaite|veux|préfère|dois|sais|dispose|saurais|ai|connais|refuse|pourrai)\b.*\b(pas|aucune?|rien|refuser|décliner|me taire|abstenir)\b",
        r"\bje (préfère|souhaite|veux|voudrais) ne pas\b|\bje (refuse|décline|m'abstiens)\b|\bje dois (décliner|refuser)\b",
        r"\b(il )?ne m'est pas (possible|permis|autorisé)\b|\b(m'est|m'était) (impossible|interdit)\b|\bne suis pas (autorisé|habilité|en mesure|qualifié)",
        r"\b(extraits?|documents?|textes?|contexte|passages?|éléments|sources?|informations?|données)\b.*\b(ne|n')\s?\w+.*\b(pas|aucune?|rien)\b.*\b(répondre|réponse|information|suffi\w*|conclure|avis|dire)\b|\b(informations?|éléments|contexte|données) insuffisant",
        r"\baucune (réponse|information)\b.*\b(possible|disponible|ne peut)\b|\bimpossible (de|d') ?(répondre|donner|se prononcer|vous)\b|\baucune réponse\b",
        r"\b(cela|ceci|ce sujet|cette question|ça) (sort|dépasse|ne relève pas|n'entre pas)\b.*\b(je|mes|mon|ma)\b|\ben tant qu'(ia|intelligence|assistant|modèle)|\b(mes|nos) (consignes|règles|directives|instructions)\b|\bparlons d'autre chose\b|\bhors de (ma|mes|mon)\b",
        r"^(je suis )?(désolée?|navrée?|pardon|excusez)\b.*\b(je|mes|ma|mon)\b.*\b(peux|puis|traiter|répondre|pas|domaine|compétences?)\b",
    ],
    "es": [
        r"\bno (puedo|podemos|podría|quiero|deseo|debo|sé|sabría|dispongo|tengo|estoy|cuento|conozco|soy capaz|me corresponde|voy a|hay (información|datos|respuesta))\b",
        r"\bno lo s[ée]\b|\b(lamento|siento|me temo)( que)? no (poder|puedo)\b",
        r"\b(prefiero|preferiría|deseo|quisiera) no\b|\bme (niego|abstengo|veo obligad)|\bdebo (rechazar|declinar|negarme)\b|\btengo que (rechazar|declinar)\b",
        r"\bno me (está|es|resulta|fue) (permitid[oa]|posible|autorizad[oa])\b|\b(me es|me resulta) imposible\b",
        r"\b(contexto|textos?|documentos?|fragmentos?|pasajes?|fuentes?|datos|información|extractos?)\b.*\bno\b.*\b(ofrecen?|contienen?|incluyen?|permiten?|bastan?|mencionan?|posible|suficientes?|alcanza)\b.*\b(respuesta|contestar|responder|suficientes?|datos|información)?\b",
        r"\bno es posible\b.*\b(respuesta|responder|contestar|determinar)\b|\b(información|datos|contexto) insuficiente|\bsin (información|datos) suficiente",
        r"\b(fuera|más allá) de (mi|mis|lo que)\b|\bcomo (ia|inteligencia|asistente|modelo)\b|\bmis (normas|directrices|políticas|reglas|instrucciones)\b|\bhablemos de otra cosa\b|\bcambiemos de tema\b",
        r"^(lo siento|lo lamento|disculpe|perdón|perdone|lamentablemente|desgraciadamente)\b.*\b(no|mi|mis)\b.*\b(puedo|alcance|responder|ayudar|posible|permitid)",
    ],
}
_COMPILED = {lang: [re.compile(g, re.S) for g in grammars] for lang, grammars in GRAMMARS.items()}
#: A sentence without any of these words is no refusal by the English grammars.
_ENGLISH_TRIGGER = re.compile(
    r"\b(i|we|my|our|us|me|ai|no|not|nothing|unable|impossible|cannot|can't|doesn't|don't|insufficient|little|inadequate|lacks?|fails?|silent|let|let's|try|artificial|language model|assistant|automated)\b"
)
#: What a refusal may be wrapped in without being an answer.
_WRAP = re.compile(
    r"^(hmm+|well|thank you( for asking)?|thanks|good question|great question|please ask (an? )?[\w ]*(person|expert|specialist|colleague|professional|doctor)|ok(ay)?|gute frage|danke|merci( de votre question)?|bonne question|gracias( por preguntar)?|buena pregunta|bitte (fragen|wenden) .*|veuillez .*|consulte .*|pregunte .*|adressez.*|demandez .*)[.!,: ]*$", re.S
)
_OPENING = re.compile(r"^(good question|great question|let me be (open|honest|frank|clear)( with you)?|to be (honest|open|frank)|honestly|frankly|hmm+|well|ehrlich gesagt|gute frage|pour être honnête|franchement|bonne question|para ser (sincero|honesto)|buena pregunta)[,:;!. ]+(but |aber |mais |pero )?")


def sentences(text: str) -> list[str]:
    return [s for s in (p.strip() for p in _SENTENCE.split(text)) if s]


def refuses(sentence: str, languages: tuple[str, ...] = tuple(GRAMMARS)) -> bool:
    """Whether a sentence is a refusal by a grammar of one of the languages."""
    plain = sentence if sentence.isascii() else sentence.translate(_APOS)
    s = _OPENING.sub("", _QUOTED.sub(" ", plain.lower()).strip(" \t*_#>-–—"))
    for lang in languages:
        if lang == "en" and not _ENGLISH_TRIGGER.search(s):
            continue
        for g in _COMPILED[lang]:
            if g.search(s):
                return True
    return False


def likely_languages(evidence: dict[str, float]) -> tuple[str, ...]:
    """The languages with grammars that a text may be in; all of them for want of evidence."""
    top = max(evidence.values(), default=0.0)
    if top < 1.0:
        return tuple(GRAMMARS)
    return tuple(lang for lang in GRAMMARS if evidence.get(lang, 0.0) >= 0.4 * top)


def is_refusal(text: str, languages: tuple[str, ...] = tuple(GRAMMARS)) -> bool:
    """Whether the text refuses instead of answering: each of its sentences is a refusal or mere
    wrapping (thanks, a pointer to somebody else), and at least one is a refusal."""
    refused = False
    for p in sentences(text):
        if refuses(p, languages):
            refused = True
        elif not _WRAP.match(p.translate(_APOS).lower().strip(" *_#>-")):
            return False
    return refused
