"""Is a pair of capitalised words the name of a person? A logistic score of structure and context.

The features say what stands before, after and inside a candidate: titles and roles, verbs
that persons take, determiners and place prepositions, nouns of things, a common given name, a name next to it. Their weights are fitted on SAMPLE_SIZE labelled sentences (the
bound of the sample) that templates below build from common and invented words by a seeded rule;
held-out templates are in the tests. A common given name is one feature of nine: names
without it are found by their context, and with it places and products are still turned down.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np

SAMPLE_SIZE = 4000

# --- fixed values -----------------------------------------------------------------
#: Common given names of several languages.
GIVEN = frozenset(
    "james john robert michael david william richard joseph thomas charles daniel matthew anthony mark paul steven andrew kenneth george joshua kevin brian edward peter"
    " jason jacob gary eric jonathan stephen larry justin scott frank benjamin samuel gregory patrick jack dennis henry adam nathan walter kyle harold carl arthur albert oliver"
    " mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley kimberly emily donna michelle carol amanda melissa"
    " deborah stephanie rebecca laura helen sharon cynthia kathleen amy angela anna ruth brenda pamela nicole katherine samantha christine emma catherine virginia rachel"
    " maria ana carmen lucia sofia elena isabel marta jose juan carlos luis miguel pedro pablo diego javier antonio manuel francisco marco luca giulia paolo giovanni"
    " hans klaus jürgen wolfgang heinrich karl fritz greta ingrid ursula heike sabine pierre jean jacques michel claude marie sophie camille chloé olga natalia irina"
    " svetlana ivan dmitri sergei boris vladimir nikolai katya tomas jan piotr ewa agnieszka lars sven erik astrid mohammed ahmed ali omar fatima aisha yusuf priya ravi anil".split()
)
#: Last words of places, bodies, works and things.
THINGS = frozenset(
    "Street Road Avenue Lane Park Palace Market Gate Studio Museum University College School Hospital Church Bridge River Lake Mountain Island Bay City Town Village County"
    " Republic Kingdom Company Bank Press Times Journal Award Festival Series Edition Collection Gallery Project Model Dataset System Engine Style Print Painting Photo"
    " Image Figure Table Section Chapter Appendix Garden Gardens Tower House Hall Theatre Station Airport Harbour Valley Forest Beach Square Center Centre Office Team Group"
    " Committee Ministry Department Institute Society Foundation Library Archive Hotel Cafe Restaurant Club League Cup Night Day Light Sky Sea Sun Moon Guide Policy Act".split()
)
_BEFORE_VERB = "mentions mentioned met meet saw thanks thanked asked told called calls named and with by for to from says said knows invited hired shows featuring married interviewed joined"
_PLACE_WORDS = "the a an this that these in at near of on inside outside around across through into behind over under via visit visited"
# ----------------------------------------------------------------------------------

_MENTION = re.compile(rf"\b(?:{'|'.join(_BEFORE_VERB.split())})[ \n]$")
_PLACE = re.compile(rf"\b(?:{'|'.join(_PLACE_WORDS.split())})[ \n]$", re.I)
_PERSON_VERB = re.compile(
    r"(?:,? who(?:se)? | (?:was born|is an?|was an?|has been|had been|died|lives?|lived|works?|worked|says?|said|wrote|writes|told|asked|painted|drew|took|sent|made|met|went|came|thinks?|thought|wants?|wanted|signed|agreed|left|spoke|joined|moved|called|studied|taught|grew|and (?:her|his|their)|"
    r"[a-z]{3,}ed (?:the|a|an|her|his|their|it|to|at|in|by|that|on)) ?)"
)


def features(text: str, start: int, end: int, cued: bool, followed: bool, joined: bool, stopped: bool) -> tuple[float, ...]:
    """``cued``, ``followed``, ``joined``: a role, title or label before it, a possession or quote after
    it, a name it is listed with. ``stopped``: it begins or ends with a word that no name has."""
    found = text[start:end]
    words = re.split(r"[ ,]+", found)
    before = text[max(0, start - 16) : start]
    bare = not (cued or followed or joined)  # what stands around it matters where no cue is
    return (
        1.0,
        words[-1 if "," in found else 0].lower() in GIVEN,
        cued,
        followed,
        joined,
        bool(_PERSON_VERB.match(text, end)),
        bool(_MENTION.search(before)),
        bare and bool(_PLACE.search(before)),
        bare and (words[-1] in THINGS or words[0] in THINGS),
        stopped,
    )


_PEOPLE = (
    "{} was born in 1950", "Later {} moved to the coast", "In spring {} painted two walls", "The letter mentions {} twice", "We met {} there", "{}, who lives next door, called",
    "{} said it was fine", "the work was done with {} last week", "They asked {} about it", "{} and her sister left", "A report named {} as well", "{} sent the files",
)
_OTHERS = (
    "The {} opened in 1950", "the walk through {} took an hour", "In {} it rained", "We stayed near {} for a week", "a view of {} at dusk", "{} is closed today", "the {} model was used",
    "{} prints look warm", "They drove to {} and back", "an old {} poster", "see {} for the settings", "{} opened the show",
)


def sample(size: int = SAMPLE_SIZE, seed: int = 11) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, is a person) by a seeded rule."""
    rng = random.Random(seed)
    made = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))).capitalize() + rng.choice(["", "n", "r", "s", "ski", "ova"])
    given, things = sorted(g.capitalize() for g in GIVEN), sorted(THINGS)
    out = []
    for i in range(size):
        person = i % 2 == 0
        if person:
            name = f"{rng.choice(given) if rng.random() < 0.7 else made()} {made()}"
        else:
            name = f"{made()} {rng.choice(things) if rng.random() < 0.6 else made()}"
        template = rng.choice(_PEOPLE if person else _OTHERS)
        at = template.index("{}")
        out.append((template.format(name), at, at + len(name), person))
    return out


@functools.lru_cache(maxsize=2)
def weights(size: int = SAMPLE_SIZE) -> tuple[float, ...]:
    """Weights of ``features`` by Newton steps on the sample. Cues are no part of its templates: they are
    given as labels of their own, so that each of them alone carries a candidate."""
    rows, labels = [], []
    for i, (text, start, end, person) in enumerate(sample(size)):
        # a tenth of the persons stand behind a cue of one kind, and a tenth of the others begin with a stop word
        kind = i // 2 % 30 if person else -1
        rows.append(features(text, start, end, kind == 0, kind == 1, kind == 2, not person and i // 2 % 10 == 0))
        labels.append(person)
        if kind in (0, 1, 2):
            bare = [1.0] + [0.0] * (len(rows[-1]) - 1)
            bare[2 + kind] = 1.0
            rows.append(tuple(bare))
            labels.append(True)
            stop = list(bare)
            stop[9] = 1.0
            rows.append(tuple(stop))
            labels.append(False)
    x, y = np.array(rows, float), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return tuple(w.tolist())


def is_person(values: tuple[float, ...], w: tuple[float, ...]) -> bool:
    return sum(v * c for v, c in zip(values, w, strict=True)) > 0
