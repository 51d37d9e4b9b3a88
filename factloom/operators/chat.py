"""What a question to the assistant is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import once

#: Whole questions that are greetings, and phrases that tell an intent.
GREETINGS = ("hi", "hello", "hey", "hi there", "hello there", "good morning", "good afternoon", "good evening")
PHRASES = {
    "assistant": ("who are you", "what are you", "tell me about yourself", "introduce yourself", "hi who are you", "hello who are you", "hey who are you"),
    "assistant_age": ("how old are you", "what is your age", "your age", "are you old"),
    "identity": ("who am i", "who i am", "what do you know about me", "what you know about me", "tell me about me", "tell me about myself", "do you know me", "what is my profile", "summarize me", "describe me"),
    "review": ("review", "what should i review", "review queue", "pending facts", "pending candidates", "what should i accept", "what should i fix"),
    "profile": ("profile", "my profile", "trusted profile", "build profile", "rebuild profile"),
    "noise": ("noise", "noise data", "noise pool", "check noise", "check the noise", "check the noise data", "show noise", "show noise data"),
}
SAVE = ("save this info", "save this information", "will you save", "can you save", "remember this", "store this", "update my profile", "add this to my profile")
PERSONAL = ("i am ", "i'm ", "my name is ", "years old", "my age is ")


def normalize_question(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(text)), "?!", ""), r"\s+", " "))


def _intent(q: Column) -> Column:
    def has(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | q.contains(w)
        return hit

    return (
        F.when(has(PHRASES["assistant"]), "assistant")
        .when(has(PHRASES["assistant_age"]), "assistant_age")
        .when(q.isin(*GREETINGS), "greeting")
        .when(has(PHRASES["noise"]), "noise")
        .when(has(SAVE) & has(PERSONAL), "save_info")
        .when(has(PHRASES["identity"]), "identity")
        .when(has(PHRASES["profile"]), "profile")
        .when(has(PHRASES["review"]), "review")
        .otherwise("llm")
    )


def intent(text: Column) -> Column:
    """The first intent that fits, in the order in which questions are dispatched; ``llm`` if none does."""
    return once(normalize_question(text), _intent)
