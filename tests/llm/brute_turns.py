"""Speaker turns by plain loops, for comparison on small tables."""

import regex

SOUNDS = {
    "inaudible", "paper rustling", "clears throat", "phone rings", "door slams", "laughs", "coughs", "beep", "soft music fades", "music", "crosstalk", "laughter", "indistinct", "theme music playing", "long pause",
    "everyone laughs", "applause", "sighs", "leise musik", "unverständlich", "lacht", "applaus", "räuspert sich", "musik", "tür knallt", "gelächter", "seufzt", "telefon klingelt", "hustet", "lange pause",
    "pausa larga", "suspira", "soupir", "tose", "risas", "musique", "rires", "aplausos", "se ríe", "música", "música suave", "tousse", "elle rit", "musique douce", "téléphone", "suena el teléfono", "applaudissements", "long silence",
}
NOISES = {
    "en": r"u+h+|u+h*m+|e+r+|e+r+m+|e+h+m*", "de": r"ä+h+m*|ö+h+m*|e+h+m+|u+h+m+", "es": r"e+h+m*|e+m+|u+h+m*", "fr": r"e+u+h+|h+e+u+|h+u+m+|h+e+m+",
}
ALWAYS = r"h+m+|m+h+m+|mm+|u+h+-?h+u+h+|m+-h+m+"


def ms(text):
    x = (text or "").strip().rstrip("s").strip().replace(",", ".")
    try:
        total = 0.0
        for part in x.split(":"):
            total = total * 60 + float(part)
        return int(total * 1000 + 0.5)
    except ValueError:
        return None


def forms(name, role, n, out, roles):
    name = " ".join((name or "").lower().split())
    if name:
        first, _, last = name.partition(" ")
        for f in {name, first} | ({f"{first[0]}. {last}"} if last else set()):
            out.setdefault(f, set()).add(n)
    if role in ("host", "guest"):
        out.setdefault(role, set()).add(n)


def number(text):
    m = regex.fullmatch(r"\s*(?:spk|speaker)[\s_-]*0*(\d+)\s*", text or "", regex.I)
    return int(m[1]) if m else None


def turns(segments, speakers, languages):
    """segments: dicts; speakers: (episode, id, name, role); languages: series to language."""
    names = {}
    for e, i, name, role in speakers:
        forms(name, role, number(i), names.setdefault(e, {}), None)
    episodes = {}
    for s in segments:
        episodes.setdefault(s["episode_id"], {})[s["segment_id"]] = s
    result = []
    for e, rows in episodes.items():
        known = names.get(e, {})

        def who(text):
            n = number(text)
            if n is not None:
                return n
            t = regex.sub(r"\s*\((?:host|guest)\)$", "", " ".join((text or "").lower().split()))
            t = regex.sub(r"^([^,]+), (.+)$", r"\2 \1", t)
            found = known.get(t, ())
            return next(iter(found)) if len(found) == 1 else None

        far = float("inf")
        order = sorted(rows.values(), key=lambda s: (far if ms(s["start_time"]) is None else ms(s["start_time"]), far if ms(s["end_time"]) is None else ms(s["end_time"]), s["segment_id"]))
        spoken = []
        for s in order:
            t = s["transcript"] or ""
            t = regex.sub(r"^\s*(?:[\[(<](?:[\d:.]+s?)(?: --> [\d:.]+)?[\])>]|@[\d:.]+)\s*", "", t)
            m = regex.match(r"\s*(\d+(?::\d+){1,2}(?:\.\d+)?)(?=\s|$)", t)
            if m and abs(ms(m[1]) - (ms(s["start_time"]) or 0)) <= 2000:
                t = t[m.end() :]
            speaker = None
            m = regex.match(r"\s*(?:>> |- )?(?:\[([^\]]+)\]|([^\[\]:–]{1,40}?):(?=\s)|([^\[\]:–]{1,40}?) –(?=\s))", t)
            if m:
                speaker = who(m[1] or m[2] or m[3])
                if speaker is not None:
                    t = t[m.end() :]
            for a, b in (r"\[", r"\]"), ("<", ">"), (r"\{", r"\}"), ("♪", "♪"), (r"\(\(", r"\)\)"):
                t = regex.sub(f"{a}.*?{b}", " ", t)
            t = regex.sub(r"\(([^()]*)\)|\*([^*]*)\*", lambda m: " " if (m[1] or m[2] or "").strip().lower() in SOUNDS else m[0], t)
            noise = f"(?:{NOISES[languages[s['series_id']]]}|{ALWAYS})"
            words = [w for w in t.split() if any(ch.isalnum() for ch in w) and not regex.fullmatch(noise, regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w), regex.I)]
            if words:
                spoken.append([who(s["speaker_label"]) if speaker is None else speaker, s["segment_id"], len(words)])
        last = next((x[0] for x in spoken if x[0] is not None), None)
        mine = []
        for x in spoken:
            last = last if x[0] is None else x[0]
            if mine and mine[-1][1] == last:
                mine[-1][3] = x[1]
                mine[-1][4] += x[2]
            else:
                mine.append([e, last, x[1], x[1], x[2]])
        result += [(a, None if b is None else f"spk_{b}", c, d, n) for a, b, c, d, n in mine]
    return result
