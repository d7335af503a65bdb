"""Text functions as column expressions: cleaning, tests of a question's kind, snippets, urls."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contractions and what they stand for, in the order in which they are replaced (fixed values).
CONTRACTIONS = {
    "don't": "do not", "won't": "will not", "can't": "cannot", "couldn't": "could not", "wouldn't": "would not", "shouldn't": "should not", "didn't": "did not", "doesn't": "does not",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "hasn't": "has not", "haven't": "have not", "hadn't": "had not", "i'm": "i am", "you're": "you are",
    "we're": "we are", "they're": "they are", "it's": "it is", "that's": "that is", "what's": "what is", "where's": "where is", "who's": "who is", "how's": "how is", "let's": "let us",
    "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have", "i'll": "i will", "you'll": "you will", "we'll": "we will", "they'll": "they will", "i'd": "i would",
    "you'd": "you would", "we'd": "we would", "they'd": "they would", "dont": "do not", "wont": "will not", "cant": "cannot", "couldnt": "could not", "wouldnt": "would not",
    "shouldnt": "should not", "didnt": "did not", "doesnt": "does not", "isnt": "is not", "arent": "are not", "wasnt": "was not", "werent": "were not", "hasnt": "has not", "havent": "have not",
    "hadnt": "had not", "youre": "you are", "theyre": "they are", "thats": "that is", "whats": "what is", "wheres": "where is", "whos": "who is", "hows": "how is", "youve": "you have",
    "weve": "we have", "theyve": "they have", "youll": "you will", "theyll": "they will", "youd": "you would", "theyd": "they would",
}
#: The default stopwords (fixed values): glue without meaning; question words and negations are not among them.
STOPWORDS = (
    "a an the and or but is are was were be been being have has had do does did will would could should may might must shall can to of in for on with at by from as into through during above below"
    " between under again further then once here there all each few more most other some such only own same so than too very just this that these those am i me my myself we our ours ourselves you"
    " your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves if about because although though"
).split()
#: Canonical words and their synonyms (fixed values).
SYNONYMS = {
    "start": "begin initiate commence launch", "stop": "end finish terminate quit discontinue", "find": "locate search discover", "fix": "repair resolve solve correct troubleshoot",
    "change": "modify alter revise adjust", "remove": "delete eliminate erase", "show": "display reveal", "hide": "conceal mask", "quick": "fast rapid speedy", "slow": "sluggish lagging",
    "big": "large huge massive enormous", "small": "little tiny mini compact", "many": "multiple numerous several various", "good": "great excellent fine positive", "bad": "poor terrible negative",
    "new": "latest recent modern fresh", "old": "previous former outdated past", "available": "accessible obtainable offered", "issue": "problem trouble difficulty",
    "broken": "damaged defective malfunctioning", "password": "passcode pin passphrase",
}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&ndash;": "–", "&mdash;": "—", "&rsquo;": "’", "&lsquo;": "‘", "&amp;": "&"}


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(c: Column) -> Column:
    """How many words a text has: runs of letters, apostrophes and hyphens."""
    return F.regexp_count(c, F.lit(r"[A-Za-z'\-]+"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_question(c: Column) -> Column:
    """Lower case without backslashes, contractions written out, only letters, digits, `'` and `-` kept."""
    c = F.lower(F.regexp_replace(c, r"\\", ""))
    # contractions and what is between them, in one pass: as many replacements in a row are slow to plan
    short = rf"\b(?:{'|'.join(CONTRACTIONS)})\b"
    pieces = F.regexp_extract_all(c, F.lit(f"(?s){short}|(?:(?!{short}).)+"), 0)
    known = F.create_map(*(F.lit(x) for kv in CONTRACTIONS.items() for x in kv))
    c = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}\s'\-]", " "))


def strip_html(c: Column) -> Column:
    """Text without tags, the common entities decoded."""
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "")
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def is_effectively_empty(c: Column) -> Column:
    return F.regexp_replace(strip_html(F.coalesce(c, F.lit(""))), r"[\s ]", "") == ""


def tokenize(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def remove_stopwords(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens of two or more characters that are no stopword; if none is left, those of three or more."""
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")

    def chosen(own):
        kept = F.filter(own, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.filter(own, lambda t: F.length(t) >= 3)))

    return let(tokens, chosen)


def word_synonyms(tokens: Column, keep: list[str] = ()) -> Column:
    """Tokens replaced by the word whose list has them; those of `keep` (the base's own words) stay."""
    table = {v: k for k, vs in reversed(SYNONYMS.items()) for v in vs.split() if v not in keep}
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t))


def replace_phrases(c: Column, phrases: list[tuple[str, str]]) -> Column:
    """Variants replaced by their canonical word one after another; `*` stands for word characters."""
    for variant, canonical in phrases:
        pattern = r"\b" + re.escape(variant).replace(r"\*", r"\w*") + r"\b" if "*" in variant else re.escape(variant)
        c = F.regexp_replace(c, "(?i)" + pattern, canonical)
    return c


def collapse_repeats(c: Column) -> Column:
    """Three or more of a character become two."""
    return F.regexp_replace(c, r"(.)\1{2,}", "$1$1")


def looks_clean(c: Column) -> Column:
    """False with three equal characters in a row, or a word of five or more letters with hardly a vowel."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]{5,})"), 1)
    poor = F.exists(words, lambda w: F.length(F.regexp_replace(w, "[^aeiouy]", "")) / F.length(w) < 0.15)
    return ~(c.rlike(r"(.)\1\1") | poor)


def dedup_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\s]", ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Tokens of a that b has, repeats counted, over the different tokens of both."""
    return F.size(F.filter(a, lambda t: F.array_contains(b, t))) / F.size(F.array_union(a, b))


#: How small talk begins, or is as a whole (fixed values).
CASUAL = (
    r"^(hi|hello|hey|howdy|sup|hiya|yo)\b", r"^(thanks|thank you|thx|ty|thank)\b", r"^(bye|goodbye|see ya|cya)\b", r"^(ok|okay|k|sure|alright|cool|great|nice|wow|lol)\b",
    r"^(yes|no|yeah|nope|yep|nah)\b", r"^what\s+the\s+(heck|hell)\b", r"^what(\s*\?+|\?+)\s*\?*\s*$", r"^huh\s*\??\s*$", r"^i\s+don'?t\s+(know|understand|get\s+it)\b",
    r"^i'?m\s+(not\s+sure|confused|lost)\b", r"^not\s+sure\b", r"^(uh|um|er|hmm|hm)\b", r"^(what|how|why)\s+(do\s+you\s+mean|now)\b", r"^wait\b", r"^really\s*\??\s*$",
)
#: Words that make no question of two words (fixed values).
MEANINGLESS = "the a an is are was were be to of in on at it".split()


def is_casual(c: Column) -> Column:
    """Under eight characters, or small talk."""
    return (F.length(c) < 8) | F.trim(c).rlike("(?i)" + "|".join(CASUAL))


def consonant_share(c: Column) -> Column:
    """The share of a text's letters that lie in runs of five or more consonants."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([bcdfghjklmnpqrstvwxyz]{5,})"), 1)
    inside = F.aggregate(runs, F.lit(0), lambda n, r: n + F.length(r))
    letters = F.length(F.regexp_replace(F.lower(c), "[^a-z]", ""))
    return F.when(letters > 0, inside / letters).otherwise(F.lit(0.0))


def is_gibberish(c: Column) -> Column:
    letters = F.length(F.regexp_replace(F.lower(c), "[^a-z]", ""))
    return (F.length(F.trim(c)) >= 4) & (letters >= 4) & (consonant_share(c) >= 0.4)


def is_real_question(c: Column) -> Column:
    """No small talk, two words of letters or more of which one has a meaning, and no keyboard mashing."""
    c = F.trim(c)
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: w.rlike("^[a-z]{2,}$"))
    meant = F.exists(words, lambda w: (F.length(w) >= 3) & ~w.isin(MEANINGLESS))
    return ~is_casual(c) & (F.size(words) >= 2) & meant & (consonant_share(c) <= 0.4)


SPAM = r"(?i)\b(viagra|cialis|casino|poker|lottery)\b|https?://\S{50,}|(.)\2{5,}"


def is_spam(c: Column) -> Column:
    return c.rlike(SPAM)


#: What counts as a way to get in touch (fixed values).
CONTACT_WORDS = ("contact", "reach", "call", "email", "phone", "fax", "location", "address", "visit us", "stop by")
CONTACT = {
    "phone": r"\(?\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}", "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "room": r"(?i)(?:room|building|suite|floor|hall|center)\s+\w+",
    "hours": r"(?i)(?:hours?|monday|tuesday|wednesday|thursday|friday|open|closed).*\d{1,2}:\d{2}", "url": r"https?://[^\s]+",
    "words": f"(?i)(?:{'|'.join(CONTACT_WORDS)})", "box": r"(?i)P\.?O\.?\s*Box",
}


def has_contact_info(c: Column) -> Column:
    """If c matches one of CONTACT. A pattern is only tried on texts that hold what it can't do without, which is found faster; the
    words are plain, so to hold one is to match, and a bracket before a number decides nothing."""
    def held(lower):
        has = lambda *parts: reduce(or_, (F.contains(lower, F.lit(x)) for x in parts))
        words = has(*CONTACT_WORDS)
        hours = has(":") & c.rlike(r"\d:\d{2}") & has("hour", "monday", "tuesday", "wednesday", "thursday", "friday", "open", "closed") & c.rlike(CONTACT["hours"])
        room = has("room", "building", "suite", "floor", "hall", "center") & c.rlike(CONTACT["room"])
        return words | (has("http") & c.rlike(CONTACT["url"])) | (has("@") & c.rlike(CONTACT["email"])) | hours | room | (has("box") & c.rlike(CONTACT["box"])) | c.rlike(CONTACT["phone"].removeprefix(r"\(?"))

    return let(F.lower(c), held)


#: Signs of an answer that gives none (fixed values).
REFUSAL = r"(?i)\b(sorry|i can only help with|i'm only able to help with|i'm here to help with)\b"
ADMISSION = r"(?i)\b(i don't (have|know)|i do not (have|know)|i'm not sure|i am not sure|i can't (find|tell)|don't have (information|details|info|data|specifics|the (current|specific|exact)))"
INTRODUCTION = r"(?is)\b(i'm|i am|my name is)\b.{0,80}\b(representative|assistant|here to help|here at)\b"
OFFER = r"(?i)\b(how can i help|what can i (help|assist)|here to help|help you (with|today)|assist you)"
REDIRECT = r"(?i)\b(contact|reach out to|visit|call|email|speak with|talk to)\b.*\b(office|department|advisor|staff|team|registrar|bursar|financial aid)\b"
SPECIFIC = (
    r"(?i)\b(\d{3}[-.\s]\d{3,4}|\(\d{3}\)\s*\d{3,4}|\d{1,2}:\d{2}|monday|tuesday|wednesday|thursday|friday|saturday|sunday|\$\d+|deadline|requirement|process|step|application|form|submit|apply|located"
    r"|room\s+[\w\d]+|building|floor|suite|address|street|avenue|hall|campus|hours|open\s+(from|until|at)|closed)\b|[a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9.-]+|https?://"
)


def is_generic_deflection(c: Column) -> Column:
    """A short answer that refuses, admits to not knowing, introduces itself, or sends elsewhere without anything specific."""
    text = F.lower(strip_html(c))
    n = words_of(text)
    return (text.rlike(REFUSAL) & (n < 40)) | (text.rlike(ADMISSION) & (n < 80)) | ((c.rlike(INTRODUCTION) | c.rlike(OFFER)) & (n < 80)) | ((n <= 40) & text.rlike(REDIRECT) & ~text.rlike(SPECIFIC))


def citation_snippet(c: Column) -> Column:
    """At most 200 characters: whole, or to the last sentence end in 150-220, or to a word's end with an ellipsis."""
    c = squeeze(c)
    sentence = F.regexp_extract(F.substring(c, 1, 220), r"^(.{149,219}[.!?])(?=\s|$)", 1)
    cut = F.regexp_extract(F.substring(c, 1, 200), r"^(.{100,})\s\S*$", 1)
    cut = F.when(cut == "", F.substring(c, 1, 200)).otherwise(cut)
    return F.when(F.length(c) <= 200, c).when(sentence != "", sentence).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:]+$", ""), F.lit("…")))


#: Words of a question that are no search terms, phrases that mark an answer (in a chunk, in a sentence), and those that
#: say what follows if a rule is not met (fixed values).
QUESTION_WORDS = (
    "what when where why who how which is are was were be been being do does did have has had a an the and or but if then than i my me we our us you your to of in on for with at by from up out"
    " can could should would will may might must this that these those it its about some any all no not"
).split()
ANSWER_SIGNALS = (
    "must", "required", "requires", "requirement", "minimum", "at least", "no more than", "eligible", "qualify", "allowed", "not allowed", "deadline", "cutoff", "last day to", "gpa of", "grade of",
    "average of", "in order to", "to be eligible",
)
SENTENCE_SIGNALS = (
    "must", "required", "requires", "requirement", "need ", "needs ", "needed", "minimum", "at least", "no more than", "up to ", "maximum", "no fewer than", "no later than", "or higher", "or above",
    "or more", "or less", "or greater", "eligible", "ineligible", "qualify", "qualifies", "allowed", "not allowed", "permitted", "not permitted", "in order to", "to be eligible", "to qualify",
    "deadline", "cutoff", "last day to", "by the end of", "gpa of", "grade of", "average of",
)
UNMET = ("who do not meet", "who fail to", "who fails to", "if students do not", "if you do not", "if you fail", "who have not met", "do not meet these")


def search_terms(question: Column) -> Column:
    """The different words of letters and digits of a question, three characters or more, that are search terms."""
    found = F.regexp_extract_all(F.lower(question), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(QUESTION_WORDS)))


def _held(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases a text holds."""
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)))


def _signs(lower: Column) -> Column:
    return 3 * F.least(_held(lower, ANSWER_SIGNALS), F.lit(4)) - F.when(_held(lower, UNMET) >= 2, 5).otherwise(0)


def terms_held(text: Column, terms: Column) -> Column:
    """How many of the search terms a text holds."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def answer_body(chunk: Column) -> Column:
    """(signs, runs): what score_for_question() needs of a chunk whatever the question. A term has letters and digits alone, so a chunk
    holds it if one of its different runs of them does."""
    return let(F.lower(chunk), lambda lower: F.struct(_signs(lower).alias("signs"), F.array_join(F.array_distinct(F.regexp_extract_all(lower, F.lit("([a-z0-9]{3,})"), 1)), " ").alias("runs")))


def score_for_question(chunk: Column, question: Column) -> Column:
    """2 for every search term that the chunk holds, 3 for every sign of an answer (four at most), 5 less if two phrases or more say what follows if a rule is not met."""
    return let(F.lower(chunk), lambda lower: 2 * terms_held(lower, search_terms(question)) + _signs(lower))


def relevant_snippet(chunk: Column, question: Column) -> Column:
    """The citation snippet of the chunk's sentence that answers a question best; of the whole chunk where none does.

    A sentence has four words or more. It has 2 for every search term and 2 for all of them in a row, 3 for every sign of
    an answer (6 at most), 2 for a decimal number or 1 for a whole one unless a year is named, and 4 less if it says what
    follows if a rule is not met. The first of the best counts."""
    text = F.trim(F.regexp_replace(F.regexp_replace(strip_html(chunk), r"[ \t]+", " "), r"[ \t]*\n[ \t]*", "\n"))

    def points(sentence, terms):
        def of(lower):
            held = F.size(F.filter(terms, lambda t: F.contains(lower, t)))
            row = F.when((F.size(terms) > 1) & F.contains(lower, F.array_join(terms, " ")), 2).otherwise(0)
            number = F.when(lower.rlike(r"\b\d+\.\d+\b"), 2).when(lower.rlike(r"\b\d{1,4}\b") & ~lower.rlike(r"\b(19|20)\d{2}\b"), 1).otherwise(0)
            return 2 * held + row + F.least(3 * _held(lower, SENTENCE_SIGNALS), F.lit(6)) + number - F.when(_held(lower, (*UNMET, "students who don't")) > 0, 4).otherwise(0)

        return let(F.lower(sentence), of)

    def choose(own):
        scores = F.transform(own["sentences"], lambda x: points(x, own["terms"]))

        def best(found):
            top = F.array_max(found)
            at = F.when(top < 0, F.lit(1)).otherwise(F.array_position(found, top).cast("int"))
            return F.when(top == 0, own["text"]).otherwise(F.get(own["sentences"], at - 1))

        none = (F.size(own["sentences"]) == 0) | (F.size(own["terms"]) == 0)
        return F.when(none, own["text"]).otherwise(let(scores, best))

    def split(whole):
        sentences = F.filter(F.split(whole, r"(?:(?<=[.!?])\s+(?=[A-Z0-9]))|(?:\n+)"), lambda x: (F.trim(x) != "") & (words_of(x) >= 4))
        return let(F.struct(whole.alias("text"), sentences.alias("sentences"), search_terms(question).alias("terms")), choose)

    return let(let(text, split), citation_snippet)


PRONOUNS = r"(?i)\b(it|its|they|them|their|he|she|his|her)\b|^(what about|how about|and|but|also|what if|tell me more|more on|more about)\b"


def needs_rewrite(c: Column) -> Column:
    """The question leans on what was said before."""
    return c.rlike(PRONOUNS) | ((words_of(c) < 6) & c.rlike(r"(?i)^(that|this|those|these)\b"))


def conversation_id(first_question: Column, ip: Column) -> Column:
    return F.md5(F.concat_ws("|", strip_html(first_question), ip))


def kb_text(question: Column, response: Column) -> Column:
    return F.concat_ws("\n\n", F.when(F.trim(question) != "", F.trim(question)), squeeze(strip_html(response)))


def normalise_url(c: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, fragment or port; a text without host is left alone."""
    m = r"(?i)^([a-z][a-z0-9+.-]*)://([^/?#:]+)(?::\d+)?([^?#]*)(\?[^#]*)?"
    part = lambda k: F.regexp_extract(c, m, k)
    path = F.regexp_replace(part(3), "/+$", "")
    return F.when(part(2) == "", c).otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), part(4)))


def is_normalised_url(c: Column) -> Column:
    """Whether normalise_url() surely leaves a url as it is; one look, where that takes six."""
    return c.rlike(r"^[a-z][a-z0-9+.-]*://[a-z0-9.-]+(/|/[^?#\s]*[^/?#\s])(\?[^#\s]*)?\z")


SKIPPED = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|jpe?g|png|gif|svg|mp[34]|css|js|ico|xml)(\?|$)"


def resolve_url(link: Column, base: Column) -> Column:
    """An absolute url for a page's link; null for other schemes."""
    link = F.trim(F.regexp_replace(link, "#.*$", ""))
    scheme, host = F.regexp_extract(base, r"^([^:]+):", 1), F.regexp_extract(base, r"^[^:]+://([^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^:]+://[^/?#]+([^?#]*)", 1), "[^/]*$", "")
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(link == "", F.lit(None)).when(link.rlike("(?i)^https?://"), link).when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def is_allowed_url(c: Column, base: Column) -> Column:
    host = lambda u: F.lower(F.regexp_extract(u, r"^[^:]+://([^/?#:]+)", 1))
    return c.isNotNull() & (host(c) == host(base)) & ~c.rlike(SKIPPED)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}'\-]+"))


#: Attempts to give instructions (fixed values).
INJECTION = (
    r"ignore (all |your )?(previous |above |prior )?instructions?", r"forget (everything|all|your instructions)", r"you are now", r"pretend (you are|to be)",
    r"act as (a |an )?(different|unrestricted|jailbreak)", r"system prompt", r"\[INST\]|<\|im_start\|>|<\|system\|>",
)


def is_prompt_injection(c: Column) -> Column:
    return c.rlike("(?i)" + "|".join(INJECTION))


def looks_truncated(c: Column) -> Column:
    """The last character, closing marks aside, ends no sentence."""
    tail = F.right(F.regexp_replace(F.rtrim(c), r"[\"'”’)\]*_\s]+$", ""), F.lit(1))
    return ~tail.isin(".", "!", "?", ":")


def content_hash(c: Column) -> Column:
    """SHA-1 of the plain text: equal content, equal hash, whatever the markup."""
    return F.sha1(squeeze(strip_html(c)).cast("binary"))


def modernize_html(c: Column) -> Column:
    """Office markup, wrappers of style and empty elements removed."""
    for pattern, new in (
        (r"(?is)<\?xml.*?\?>|<!--\[if.*?<!\[endif\]-->|</?o:p[^>]*>", ""), (r"(?i)\s(class|style)=\"[^\"]*mso[^\"]*\"", ""), (r"(?i)</?(font|center|big|small)\b[^>]*>", ""),
        (r"(?i)(&nbsp;\s*){2,}", " "), (r"(?i)<(span|p|div)\b[^>]*>\s*</\1>", ""), (r"(?i)<(span|p|div)\b[^>]*>\s*</\1>", ""), (r"(?i)\s(class|style|id)=\"\"", ""), (r"[ \t]+", " "),
    ):
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)
