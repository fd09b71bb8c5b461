"""Signature rules for license bodies, headers and notices, written over lower-case words.

Each has a label, a priority, a confidence, two keywords and a regex. ``..`` stands for up to GAP
characters of other words. A rule of a whole body reaches over the disclaimer or clause that other
licenses share, so it contains what their rules find there.
"""

from __future__ import annotations

GAP = 2000

GRANT = "permission is hereby granted free of charge to any person(?: or organization)? obtaining a copy"
COPY = "of this software and associated documentation files(?: the software)?"
DEAL = "to deal in the software without restriction"
WARRANTY = "(?: .. particular purpose(?: title)? and non ?infringement)?"
USE = "redistribution and use(?: of this software)? in source and binary forms(?: of this software)?(?: with or without modification)?"
FEE = "permission to use copy modify (?:and(?: or)? )?distribute this software(?: and its documentation)? for any purpose"
DERIVED = "(?: derived from this software)?"
GNU = "you can redistribute it and or modify it under the terms of the (?:version [123](?: [01])? of the )?gnu"
FSF = "general public licen[cs]e(?: version [123](?: [01])?)? as published by the free software foundation (?:either )?"
DISCLAIMS = "(?: the software is provided as is and .. disclaims? all warranties)?"
SUBJECT = "(?:the contents of this file|this source code form) (?:are|is) subject to(?: the terms of)? the"
MADE = "this program and the accompanying materials are (?:made available|licensed) under the terms of the eclipse"

#: Bodies of permissive licenses.
PERMISSIVE = (
    ("mit", 2, 0.95, "permission", "hereby granted", f"{GRANT} {COPY} {DEAL}(?: .. subject to the following conditions)?"),
    ("mit", 1, 0.7, "permission", "hereby granted", "permission is hereby granted free of charge"),
    ("mit", 1, 0.6, "merchantab", "software is provided", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("mit", 1, 0.5, "software is provided", "as is", "the software is provided as is(?! and)"),
    ("mit-0", 3, 1.0, "permission", "hereby granted", f"{GRANT} {COPY} {DEAL} .. to whom the software is furnished to do so the software is provided as is{WARRANTY}"),
    ("json", 3, 1.0, "permission", "good not evil", f"{GRANT} {COPY} {DEAL} .. the software shall be used for good not evil{WARRANTY}"),
    ("ncsa", 3, 1.0, "permission", "deal with the software", f"{GRANT} {COPY} to deal with the software without restriction{WARRANTY}"),
    ("x11", 3, 0.9, "permission", "except as contained in this notice", f"{GRANT} {COPY} {DEAL} .. except as contained in this notice the names? of .. in advertising or otherwise to promote the sale"),
    ("boost-1.0", 3, 1.0, "permission", "or organization obtaining", f"{GRANT} of the software and accompanying documentation covered by this license{WARRANTY}"),
    ("ofl-1.1", 3, 1.0, "permission", "font software", f"{GRANT} of the font software"),
    ("unicode", 3, 1.0, "permission", "data files", f"{GRANT} of (?:the unicode )?data files and any associated documentation{WARRANTY}"),
    ("isc", 2, 0.95, "permission", "distribute this software for any purpose", f"permission to use copy modify (?:and(?: or)? )?distribute this software for any purpose(?: with or without fee is hereby granted provided that .. appear in all copies{DISCLAIMS})?"),
    ("isc", 1, 0.9, "permission", "distribute this software", "permission to use copy modify (?:and(?: or)? )?distribute this software(?! and its documentation)"),
    ("0bsd", 3, 1.0, "permission", "distribute this software for any purpose", "permission to use copy modify (?:and(?: or)? )?distribute this software for any purpose with or without fee is hereby granted the software is provided as is(?: .. disclaims? all warranties)?"),
    ("hpnd", 2, 0.9, "permission", "and its documentation for any purpose", f"{FEE}(?: and)? (?:with or )?without fee is hereby granted provided that"),
    ("postgresql", 3, 1.0, "permission", "without a written agreement", f"{FEE} without fee and without a written agreement is hereby granted"),
    ("bsd", 1, 0.85, "redistribut", "source and binary forms", USE),
    ("bsd-1-clause", 3, 0.95, "redistribut", "retain the above copyright", f"{USE} .. redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("bsd-2-clause", 3, 0.95, "redistribut", "provided with the distribution", f"{USE} .. redistributions in binary form must reproduce .. materials provided with the distribution (?:this|the) software is provided"),
    ("bsd-3-clause", 4, 0.95, "redistribut", "endorse or promote", f"{USE} .. may (?:not )?be used to endorse or promote products{DERIVED}"),
    ("bsd-3-clause", 2, 0.8, "endorse or promote", "neither the name", "neither the names? of .. may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 5, 0.95, "redistribut", "advertising materials", f"{USE} .. all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?: .. may (?:not )?be used to endorse or promote products{DERIVED})?"),
    ("apache-1.0", 6, 1.0, "redistribut", "apache group", f"{USE} .. apache group must not be used to endorse or promote products{DERIVED}"),
    ("apache-1.1", 6, 1.0, "redistribut", "apache software foundation", f"{USE} .. apache software foundation must not be used to endorse or promote products{DERIVED}"),
    ("openssl", 6, 1.0, "redistribut", "openssl project", f"{USE} .. openssl project must not be used to endorse or promote products{DERIVED}"),
    ("php-3.01", 6, 0.95, "redistribut", "name php", f"{USE} .. the name php must not be used to endorse or promote products{DERIVED}"),
    ("zlib", 2, 0.95, "warranty", "without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", 3, 1.0, "misrepresented", "origin of this software", "the origin of this software must not be misrepresented"),
    ("zlib", 2, 0.9, "misrepresented", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng-2.0", 3, 1.0, "misrepresented", "origin of this source code", "the origin of this source code must not be misrepresented"),
    ("unlicense", 4, 1.0, "unencumbered", "free and unencumbered", f"this is free and unencumbered software released into the public domain{WARRANTY}"),
    ("unlicense", 2, 0.9, "dedicate any and all", "public domain", "dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", 3, 1.0, "what the fuck you want", "fuck", "you just do what the fuck you want to"),
    ("python-2.0", 3, 1.0, "licen", "python software foundation", "this licen[cs]e agreement is between the python software foundation"),
    ("ruby", 2, 0.8, "verbatim copies", "source form of the software", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("artistic-1.0", 3, 0.9, "semblance of artistic control", "artistic", "the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", 3, 1.0, "licen", "free software package", "this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("vim", 3, 1.0, "restrictions on distributing", "unmodified copies of vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("w3c", 3, 0.9, "this work is being provided", "copyright holders", "this work is being provided by the copyright holders under the following licen[cs]e"),
)

#: Bodies, headers and notices of the GNU family.
GNU_RULES = (
    *((f"gpl-{v}.0", 4, 1.0, "redistribut", "gnu general public", f"{GNU} {FSF}version {v}(?: of the licen[cs]e)?(?: or at your option any later version)?") for v in (1, 2, 3)),
    *((f"lgpl-{v}", 4, 1.0, "redistribut", "general public", f"{GNU} (?:lesser|library) {FSF}version {n}(?: of the licen[cs]e)?(?: or at your option any later version)?") for v, n in (("2.0", "2(?! 1)(?: 0)?"), ("2.1", "2 1"), ("3.0", "3"))),
    ("agpl-3.0", 4, 1.0, "redistribut", "affero", f"{GNU} affero {FSF}version 3(?: of the licen[cs]e)?(?: or at your option any later version)?"),
    ("gpl-1.0", 4, 1.0, "licen", "february 1989", "gnu general public licen[cs]e version 1 february 1989"),
    ("gpl-2.0", 4, 1.0, "licen", "june 1991", "gnu general public licen[cs]e version 2 june 1991"),
    ("gpl-3.0", 4, 1.0, "licen", "june 2007", "gnu general public licen[cs]e version 3 29 june 2007"),
    ("lgpl-2.0", 4, 1.0, "licen", "june 1991", "gnu library general public licen[cs]e version 2 june 1991"),
    ("lgpl-2.1", 4, 1.0, "licen", "february 1999", "gnu lesser general public licen[cs]e version 2 1 february 1999"),
    ("lgpl-3.0", 4, 1.0, "licen", "june 2007", "gnu lesser general public licen[cs]e version 3 29 june 2007"),
    ("agpl-3.0", 4, 1.0, "licen", "november 2007", "gnu affero general public licen[cs]e version 3 19 november 2007"),
    ("gpl-2.0", 3, 0.9, "licen", "take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license"),
    ("gpl-3.0", 3, 0.9, "copyleft", "gnu general public", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", 3, 1.0, "copyleft", "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-3.0", 4, 1.0, "licen", "lesser general public", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("gfdl", 4, 1.0, "permission", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    *((f"gpl-{v}.0", 3, 0.9, "gpl", f"gplv{v}", f"gplv{v}(?: 0)?") for v in (1, 2, 3)),
    *((f"lgpl-{v}", 3, 0.9, "gpl", "lgplv", f"lgplv{n}") for v, n in (("2.0", "2(?! 1)(?: 0)?"), ("2.1", "2 1"), ("3.0", "3(?: 0)?"))),
    ("agpl-3.0", 3, 0.9, "gpl", "agplv3", "agplv3(?: 0)?"),
    ("mpl-1.1", 3, 0.9, "mplv", "mplv1", "mplv1 1"),
    ("mpl-2.0", 3, 0.9, "mplv", "mplv2", "mplv2(?: 0)?"),
)

#: Bodies, headers and notices of other licenses.
OTHERS = (
    ("apache-2.0", 4, 1.0, "licen", "in compliance with the license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 2, 0.9, "licen", "required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", 3, 0.95, "licen", "terms and conditions for use", "terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    *((f"mpl-{v}", 4, 1.0, "licen", "mozilla public", f"{SUBJECT} mozilla public licen[cs]e (?:version |v )?{v.replace('.', ' ')}") for v in ("1.0", "1.1", "2.0")),
    ("mpl-2.0", 3, 1.0, "copy of the mpl", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cddl-1.0", 4, 1.0, "licen", "common development and distribution", f"{SUBJECT} common development and distribution licen[cs]e"),
    *((f"epl-{v}", 4, 1.0, "licen", "eclipse public", f"{MADE} public licen[cs]e (?:version )?v? ?{v.replace('.', ' ')}") for v in ("1.0", "2.0")),
    ("edl-1.0", 4, 1.0, "licen", "eclipse distribution", f"{MADE} distribution licen[cs]e"),
    ("cpl-1.0", 4, 1.0, "licen", "common public", "the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("eupl-1.1", 4, 1.0, "licen", "eupl", "licensed under the eupl version 1 1"),
    ("eupl-1.2", 4, 1.0, "licen", "eupl", "licensed under the eupl version 1 2"),
    ("cecill-2.1", 3, 0.8, "licen", "cecill", "this software is governed by the cecill licen[cs]e under french law"),
    ("ms-pl", 2, 0.8, "licen", "accompanying software", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("ms-rl", 3, 1.0, "licen", "reciprocal grants", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e .. reciprocal grants"),
    ("sspl-1.0", 3, 1.0, "service source code", "third parties as a service", "make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl-1.1", 3, 1.0, "licen", "non production use", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", 3, 1.0, "managed service", "hosted or managed", "you may not provide the software to third parties as a hosted or managed service"),
    ("ofl-1.1", 4, 1.0, "licen", "font software", "this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("odbl-1.0", 4, 1.0, "licen", "open database", "is made available under the open database licen[cs]e"),
    ("pddl-1.0", 4, 1.0, "licen", "public domain dedication", "is made available under the public domain dedication and licen[cs]e"),
    ("cc0-1.0", 3, 0.95, "public domain", "with this deed", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0-1.0", 3, 0.9, "related or neighboring rights", "waived all copyright", "waived all copyright and related or neighboring rights"),
    ("cc0-1.0", 3, 1.0, "creativecommons org", "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    *((f"cc-{k}-{v}", 3, 1.0, "creativecommons org", "licenses by", f"creativecommons org licenses {k.replace('-', ' ')} {v.replace('.', ' ')}") for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")),
    ("public-domain", 2, 0.9, "public domain", "in", "(?:is|are|has been|have been) (?:hereby )?(?:placed |released |put |dedicated )?(?:in|into|to) the public domain"),
)


def signatures() -> list[tuple[str, int, float, str, list[str], str]]:
    """All signature rules as those of ``licenses.rules()``."""
    out = []
    for label, priority, sure, own, word, words in (*PERMISSIVE, *GNU_RULES, *OTHERS):
        words = words.replace(" .. ", f" (?:.{{0,{GAP}}}? )?").replace("as is", "“?as is”?")
        out.append((label, priority, sure, own, [word], rf"\b{words}(?= |$)"))
    return out
