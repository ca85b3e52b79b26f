"""Licence notices as fixed values: openings, headings, sentences of full texts, and identifiers.

A notice with a slot of any length (a name, a year) is given as the pieces on its sides, each a
template of its own with the same label.
"""

# Label, words, mandatory key phrase within them (None: all the words).
OPENINGS = [
    ("afl-3.0", "licensed under the academic free license version 3 0", "academic free license"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("artistic-2.0", "this is free software licensed under the artistic license 2 0", "artistic license 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement", "all advertising materials mentioning features"),
    ("bsd-licence", "licensed under the bsd license", "bsd license"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4"),
    ("cc-by-nc-nd", "this work is licensed under the creative commons attribution noncommercial noderivatives 4 0 international license", "creative commons attribution noncommercial noderivatives"),
    ("cc-by-nc-sa", "this work is licensed under the creative commons attribution noncommercial sharealike 4 0 international license", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nd", "this work is licensed under the creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4"),
    ("cc0-1.0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "to the extent possible under law"),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("cpl-1.0", "made available under the terms of the common public license v1 0 which accompanies this distribution", "common public license"),
    ("creative-commons", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "licensed under the eupl"),
    ("gfdl-1.3", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3", "gnu free documentation license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-2.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3.0-or-later", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "general public license as published by the free software foundation either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl-2.1-or-later", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "this license governs use of the accompanying software"),
    ("ncsa", "distributed under the university of illinois ncsa open source license", "university of illinois ncsa open source license"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", "developed by the openssl project"),
    ("osl-3.0", "licensed under the open software license version 3 0", "open software license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "without a written agreement is hereby granted"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("psf-2.0", "licensed under the python software foundation license version 2", "python software foundation license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
]

# Headings of licence texts.
HEADINGS = [
    ("agpl-3.0", "gnu affero general public license version 3", None),
    ("apache-2.0", "apache license version 2 0 january 2004", None),
    ("apsl-2.0", "apple public source license version 2 0", None),
    ("artistic-1.0", "the artistic license preamble", None),
    ("bsd-2-clause", "bsd 2 clause license", None),
    ("bsd-3-clause", "bsd 3 clause license", None),
    ("bsl-1.0", "boost software license version 1 0 august 17th 2003", None),
    ("busl-1.1", "business source license 1 1", None),
    ("cc-by-4.0", "creative commons attribution 4 0 international public license", None),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international public license", None),
    ("cc0-1.0", "cc0 1 0 universal", None),
    ("cddl-1.0", "common development and distribution license cddl version 1 0", None),
    ("cecill-2.1", "cecill free software license agreement", None),
    ("commons-clause", "commons clause license condition", None),
    ("elastic-2.0", "elastic license 2 0", None),
    ("epl-1.0", "eclipse public license v 1 0", None),
    ("epl-2.0", "eclipse public license v 2 0", None),
    ("eupl-1.2", "european union public licence v 1 2", None),
    ("gfdl-1.3", "gnu free documentation license version 1 3", None),
    ("gpl-1.0", "gnu general public license version 1 february 1989", None),
    ("gpl-2.0", "gnu general public license version 2", None),
    ("gpl-3.0", "gnu general public license version 3", None),
    ("ipl-1.0", "ibm public license version 1 0", None),
    ("lgpl-2.0", "gnu library general public license version 2", None),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", None),
    ("lgpl-3.0", "gnu lesser general public license version 3", None),
    ("lppl-1.3c", "latex project public license", None),
    ("mpl-1.1", "mozilla public license version 1 1", None),
    ("mpl-2.0", "mozilla public license version 2 0", None),
    ("ms-pl", "microsoft public license ms pl", None),
    ("ms-rl", "microsoft reciprocal license ms rl", None),
    ("mulan-psl-2.0", "mulan permissive software license version 2", None),
    ("ofl-1.1", "sil open font license version 1 1 26 february 2007", None),
    ("openldap-2.8", "the openldap public license version 2 8", None),
    ("qpl-1.0", "the q public license version 1 0", None),
    ("sspl-1.0", "server side public license version 1", None),
    ("upl-1.0", "universal permissive license upl version 1 0", None),
    ("w3c", "w3c software notice and license", None),
    ("wtfpl", "do what the fuck you want to public license", None),
    ("x11", "x11 license", None),
    ("zpl-2.1", "zope public license zpl version 2 1", None),
]

# Sentences from within licence texts, and pieces beside a slot.
SENTENCES = [
    ("apache-2.0", "terms and conditions for use reproduction and distribution", None),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff", "you can do whatever you want with this stuff"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software", None),
    ("bsd-4-clause", "this product includes software developed by the university of california berkeley and its contributors", "university of california berkeley and its contributors"),
    ("cc-by-sa-3.0", "distribute the resulting work only under the same similar or a compatible license", "only under the same similar or a compatible license"),
    ("creative-commons", "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons", "by exercising the licensed rights"),
    ("gpl", "when we speak of free software we are referring to freedom not price", "we are referring to freedom not price"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it", "designed to take away your freedom to share and change it"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", "is a free copyleft license for software and other kinds of works"),
    ("json", "the software shall be used for good not evil", None),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions of the software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", "if a copy of the mpl was not distributed with this file"),
    ("public-domain", "this file has been placed in the public domain", "placed in the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "altered source versions must be plainly marked as such"),
]

# Identifiers as they stand after `SPDX-License-Identifier:`. GPL-2.0 also stands at the
# beginning of GPL-2.0-or-later, and so do the like: such a line has both labels.
IDENTIFIERS = """
    0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0
    BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0
    CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CECILL-2.1 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0
    GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only
    LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1
    OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 SSPL-1.0 Unlicense UPL-1.0 WTFPL X11 Zlib ZPL-2.1
""".split()


def templates() -> list[tuple[str, str, str]]:
    """label, words, key phrase of every template."""
    lines = [(i.lower(), "spdx license identifier " + i.lower().replace("-", " ").replace(".", " "), None) for i in IDENTIFIERS]
    return [(label, words, key or words) for label, words, key in OPENINGS + HEADINGS + SENTENCES + lines]
