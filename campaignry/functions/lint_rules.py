"""Fixed values of the text lint: rules and patterns, in the order of their reports. A rule may stand twice."""

PLACEHOLDERS = (
    ("tbd", r"(?i)\bTBD\b"),
    ("todo", r"(?i)\bTODO\b"),
    ("fixme", r"(?i)\bFIXME\b"),
    ("placeholder_word", r"(?i)\bPLACEHOLDER\b"),
    ("dummy_word", r"(?i)\bDUMMY(?: URL)?\b"),
    ("unresolved_named_token", r"\b(?:[A-Z][A-Z0-9]*_)+(?:URL|LINK|ID|GID|PATH|SHA|TOKEN|HERE)\b"),
)
TOKENS = (
    ("unresolved_angle_token", r"<[^>\r\n]+>"),
    ("unresolved_brace_token", r"\{[^}\r\n]+\}"),
    ("unresolved_square_token", r"(?i)\[(?!\s*(?:name|first name|company|brand)\s*\])[^\]\r\n]+\](?!\s*\()"),
)
PHRASES = (
    ("em_dash", r"(?i)—|&mdash;|&#(?:8212|x2014);"),
    ("most_opener", r"(?im)(?:^|[.!?—]\s+|\n\s*)(?:[-*>]\s*)?Most\b"),
    ("shift_word", r"(?i)\bshift(?:s|ed|ing)?\b"),
    ("heres_the_thing", r"(?i)\bhere['’]s the thing\b"),
    ("basically", r"(?i)\bbasically\b"),
    ("essentially", r"(?i)\bessentially\b"),
    ("notably", r"(?i)\bnotably\b"),
    ("furthermore", r"(?i)\bfurthermore\b"),
    ("moreover", r"(?i)\bmoreover\b"),
    ("additionally", r"(?i)\badditionally\b"),
    ("leverage", r"(?i)\bleverag(?:e|es|ed|ing)\b"),
    ("utilize", r"(?i)\butiliz(?:e|es|ed|ing|ation)\b"),
    ("seamless", r"(?i)\bseamless(?:ly)?\b"),
    ("robust", r"(?i)\brobust\b"),
    ("unlock", r"(?i)\bunlock(?:s|ed|ing)?\b"),
    ("game_changer", r"(?i)\bgame[- ]changer\b"),
    ("dive_deep", r"(?i)\bdive deep\b"),
    ("revolutionary", r"(?i)\brevolutionary\b"),
    ("false_negative", r"(?is)\bit['’]?s not\b.{0,120}\bit['’]?s\b"),
    ("false_negative", r"(?is)\b(?:it|this|that)\s+(?:is not|isn['’]t|was not|wasn['’]t)\b.{0,140}\b(?:it|this|that)\s+(?:is|was)\b"),
    ("reversal_people", r"(?i)\bmost people think\b"),
    ("reversal_truth", r"(?i)\bthe truth is\b"),
    ("reversal_everyone", r"(?is)\beveryone\s+(?:focuses|thinks|does|uses)\b.{0,180}\b(?:the real|the truth|actually)\b"),
    ("asyndeton", r"(?i)\bNo\s+[^.!?\n]{1,80}[.!?]\s+No\s+[^.!?\n]{1,80}[.!?]\s+No\s+[^.!?\n]{1,80}[.!?]"),
    ("rhetorical_setup", r"(?im)^\s*(?:the reality|here['’]s why|the strategy)\s*[?:]\s*$"),
    ("rhetorical_question", r"(?im)^\s*(?:why\s+(?:does|do|is|are|should|would|can)|what\s+(?:does|do|is|are))\b[^?\n]{0,120}\?\s*$"),
    ("mechanism_contrast", r"(?i)\bin ways\b.{0,100}\b(?:can['’]?t|cannot)\b"),
    ("vague_authority", r"(?i)\bi(?:'ve| have) seen this play out\b|\bi see this constantly\b"),
    ("clever_comparative", r"(?is)\bbad\b.{0,120}\bgreat\b"),
    ("hashtag", r"(?<![\w/])#[A-Za-z][A-Za-z0-9_]*\b"),
)
FORMATTING = (("bold_formatting", r"\*\*|__"), ("italic_formatting", r"(?<!\*)\*(?![\s*])|(?<!_)_(?![\s_])"))
LINE_LEAD, LEAD_WORD, SAME_LEADS = r"^\s*(?:[-*+>]|\d+[.)])\s*", r"[a-z][a-z'’]*", 3
#: For each rule, strings of the folded text: one of each tuple must stand there, so that the rule can match.
SIGNS = {
    **{w: ((w,),) for w in ("tbd", "todo", "fixme", "basically", "essentially", "notably", "furthermore", "moreover", "additionally", "seamless", "robust", "unlock", "revolutionary")},
    "placeholder_word": (("placeholder",),), "dummy_word": (("dummy",),), "unresolved_named_token": (("_url", "_link", "_id", "_gid", "_path", "_sha", "_token", "_here"),),
    "unresolved_angle_token": (("<",), (">",)), "unresolved_brace_token": (("{",), ("}",)), "unresolved_square_token": (("[",), ("]",)),
    "em_dash": (("—", "&mdash;", "&#8212;", "&#x2014;"),), "most_opener": (("most",),), "shift_word": (("shift",),), "heres_the_thing": (("s the thing",),),
    "leverage": (("leverag",),), "utilize": (("utiliz",),), "game_changer": (("changer",),), "dive_deep": (("dive deep",),), "false_negative": (("s not", "isn", "wasn"),),
    "reversal_people": (("most people think",),), "reversal_truth": (("the truth is",),), "reversal_everyone": (("everyone",), ("the real", "the truth", "actually")),
    "asyndeton": (("no",), (".", "!", "?")), "rhetorical_setup": (("the reality", "s why", "the strategy"),), "rhetorical_question": (("?",), ("why", "what")),
    "mechanism_contrast": (("in ways",),), "vague_authority": (("seen this play out", "i see this constantly"),), "clever_comparative": (("bad",), ("great",)),
    "hashtag": (("#",),), "bold_formatting": (("**", "__"),), "italic_formatting": (("*", "_"),),
}
