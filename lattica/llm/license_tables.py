"""Tables of the license scan: names of licences, forms of notices, sentences of standard texts, rules."""

from __future__ import annotations

# SPDX identifiers and names by which notices call the licences.
NAMES = (
    ("0BSD", ("bsd zero clause license", "zero clause bsd license")),
    ("AFL-3.0", ("academic free license version 3.0",)),
    ("AGPL-3.0", ("gnu affero general public license version 3", "agplv3", "gnu agplv3", "agpl 3.0 license")),
    ("Apache-2.0", ("apache license version 2.0", "apache license 2.0", "apache 2.0 license", "apache 2 license", "apache license v2")),
    ("Artistic-2.0", ("artistic license 2.0",)),
    ("BSD-2-Clause", ("2 clause bsd license", "bsd 2 clause license", "simplified bsd license", "freebsd license")),
    ("BSD-3-Clause", ("3 clause bsd license", "bsd 3 clause license", "new bsd license", "modified bsd license")),
    ("BSD-4-Clause", ("4 clause bsd license", "original bsd license")),
    ("BSL-1.0", ("boost software license version 1.0", "boost software license 1.0", "boost software license")),
    ("CC-BY-4.0", ("creative commons attribution 4.0 international license", "cc by 4.0", "cc by 4.0 license")),
    ("CC-BY-NC-4.0", ("creative commons attribution noncommercial 4.0 international license", "cc by nc 4.0", "cc by nc 4.0 license")),
    ("CC-BY-NC-ND-4.0", ("creative commons attribution noncommercial noderivatives 4.0 international license", "cc by nc nd 4.0")),
    ("CC-BY-NC-SA-4.0", ("creative commons attribution noncommercial sharealike 4.0 international license", "cc by nc sa 4.0")),
    ("CC-BY-ND-4.0", ("creative commons attribution noderivatives 4.0 international license", "cc by nd 4.0")),
    ("CC-BY-SA-4.0", ("creative commons attribution sharealike 4.0 international license", "cc by sa 4.0", "cc by sa 4.0 license")),
    ("CC-BY-3.0", ("creative commons attribution 3.0 unported license", "cc by 3.0")),
    ("CC-BY-SA-3.0", ("creative commons attribution sharealike 3.0 unported license", "cc by sa 3.0")),
    ("CC0-1.0", ("creative commons zero v1.0 universal", "cc0 1.0 universal", "cc0 1.0", "cc0")),
    ("CDDL-1.0", ("common development and distribution license 1.0", "common development and distribution license")),
    ("ECL-2.0", ("educational community license version 2.0",)),
    ("EPL-1.0", ("eclipse public license v1.0", "eclipse public license 1.0")),
    ("EPL-2.0", ("eclipse public license 2.0", "eclipse public license v2.0")),
    ("EUPL-1.2", ("european union public licence 1.2", "european union public licence v1.2")),
    ("GFDL-1.3", ("gnu free documentation license version 1.3",)),
    ("GPL-2.0", ("gnu general public license version 2", "gnu general public license v2.0", "gplv2", "gnu gplv2", "gpl 2.0 license")),
    ("GPL-3.0", ("gnu general public license version 3", "gnu general public license v3.0", "gplv3", "gnu gplv3", "gpl 3.0 license")),
    ("ISC", ("isc license",)),
    ("LGPL-2.1", ("gnu lesser general public license version 2.1", "gnu lesser general public license v2.1", "lgplv2.1")),
    ("LGPL-3.0", ("gnu lesser general public license version 3", "gnu lesser general public license v3.0", "lgplv3")),
    ("LPPL-1.3c", ("latex project public license version 1.3c",)),
    ("MIT", ("mit license", "mit licence", "mit license mit", "expat license")),
    ("MIT-0", ("mit no attribution license", "mit 0 license")),
    ("MPL-1.1", ("mozilla public license version 1.1",)),
    ("MPL-2.0", ("mozilla public license 2.0", "mozilla public license version 2.0", "mpl 2.0")),
    ("MS-PL", ("microsoft public license",)),
    ("MS-RL", ("microsoft reciprocal license",)),
    ("NCSA", ("university of illinois ncsa open source license",)),
    ("ODbL-1.0", ("open database license", "open data commons open database license v1.0")),
    ("OFL-1.1", ("sil open font license version 1.1", "sil open font license 1.1")),
    ("OSL-3.0", ("open software license version 3.0", "open software license 3.0")),
    ("PostgreSQL", ("postgresql license",)),
    ("PSF-2.0", ("python software foundation license version 2", "python software foundation license")),
    ("Ruby", ("ruby license",)),
    ("Unlicense", ("unlicense",)),
    ("UPL-1.0", ("universal permissive license v1.0", "universal permissive license version 1.0")),
    ("Vim", ("vim license",)),
    ("W3C", ("w3c software notice and license",)),
    ("WTFPL", ("do what the fuck you want to public license", "wtfpl")),
    ("Zlib", ("zlib license",)),
    ("ZPL-2.1", ("zope public license version 2.1",)),
)

#: Sentences that name a licence, normalised.
FORMS = (
    "licensed under the {}", "licensed under {}", "released under the {}", "released under {}", "distributed under the {}", "distributed under the terms of the {}", "available under the {}",
    "this project is licensed under the {}", "this software is licensed under the {}", "this work is licensed under the {}", "this file is licensed under the {}", "this code is released under the {}",
    "this program is licensed under the {}", "this library is licensed under the {}", "this package is distributed under the {}", "license {}", "subject to the terms of the {}", "the {}", "{}",
)

# Short sentences by which known notices and texts are told, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0 the license": "apache-2.0-notice",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache2-asis",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind": "mit-asis",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-grant",
    "this program is distributed in the hope that it will be useful": "gpl-hope",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "all rights reserved": "reserved",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-names",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
}

_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GPL = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
# Sentences of the standard texts as they stand there, and their identifiers. Those of the GNU licences begin after the first colon or semicolon, that of the MPL ends where a scan splits it.
STANDARD = (
    ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', "apache2-asis"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "mit-grant"),
    ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.', "mit0-grant"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.', "mit-asis"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd-grant"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd-source"),
    (_BSD_BINARY, "bsd-binary"),
    ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "bsd-advertising"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-names"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc-grant"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc-grant"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0bsd-grant"),
    ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.', "isc-asis"),
    ("This software is provided 'as-is', without any express or implied warranty.", "zlib-asis"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "zlib-grant"),
    ("The origin of this software must not be misrepresented;", "zlib-origin"),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "zlib-altered"),
    ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense-free"),
    ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "wtfpl-copy"),
    ("You just DO WHAT THE FUCK YOU WANT TO.", "wtfpl-do"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v.", "mpl2-subject"),
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl2-copy"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "gpl-hope"),
    ("This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "lgpl-hope"),
    *((f"{_GPL.format(name)}{end}", f"{short}-grant{version}") for name, short in (("General Public License", "gpl"), ("Lesser General Public License", "lgpl"), ("Affero General Public License", "agpl")) for version, ends in (
        ("", (";",)),
        *((f"-{v}", (f", either version {v} of the License, or (at your option) any later version.", f"; either version {v} of the License, or (at your option) any later version.", f", either version {v} of the License.", f"; version {v} of the License.", f", version {v}.")) for v in ("3", "2.1", "2")),
    ) for end in ends),
    *((f"either version {v} of the License, or (at your option) any later version.", f"gnu-version-{v}") for v in ("3", "2.1", "2")),
    ("You should have received a copy of the GNU Lesser General Public License along with this library.", "lgpl-copy"),
    ("You should have received a copy of the GNU Lesser General Public License along with this program.", "lgpl-copy"),
    ("You should have received a copy of the GNU Affero General Public License along with this program.", "agpl-copy"),
    ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "cc0-dedicated"),
    ("This software is distributed without any warranty.", "cc0-asis"),
)

#: Licence -> ordered identifiers; a licence may have several rules.
TEXT_RULES = (
    ("Apache-2.0", ("apache-2.0-notice", "apache2-copy", "apache2-asis")),
    ("MIT", ("mit-grant", "mit-keep", "mit-asis")),
    ("MIT-0", ("mit0-grant", "mit-asis")),
    *((licence, (f"{short}-grant-{v}", hope, f"{short}-copy")) for licence, short, v, hopes in (
        ("GPL-3.0", "gpl", "3", ("gpl-hope",)), ("GPL-2.0", "gpl", "2", ("gpl-hope",)), ("LGPL-3.0", "lgpl", "3", ("lgpl-hope", "gpl-hope")), ("LGPL-2.1", "lgpl", "2.1", ("lgpl-hope", "gpl-hope")),
        ("LGPL-2.0", "lgpl", "2", ("lgpl-hope", "gpl-hope")), ("AGPL-3.0", "agpl", "3", ("gpl-hope",)),
    ) for hope in hopes),
    *((licence, (f"{short}-grant", f"gnu-version-{v}", hope, f"{short}-copy")) for licence, short, v, hopes in (
        ("GPL-3.0", "gpl", "3", ("gpl-hope",)), ("GPL-2.0", "gpl", "2", ("gpl-hope",)), ("LGPL-3.0", "lgpl", "3", ("lgpl-hope", "gpl-hope")), ("LGPL-2.1", "lgpl", "2.1", ("lgpl-hope", "gpl-hope")),
        ("LGPL-2.0", "lgpl", "2", ("lgpl-hope", "gpl-hope")), ("AGPL-3.0", "agpl", "3", ("gpl-hope",)),
    ) for hope in hopes),
    ("GPL", ("gpl-grant", "gpl-hope", "gpl-copy")),
    ("LGPL", ("lgpl-grant", "lgpl-hope", "lgpl-copy")),
    ("LGPL", ("lgpl-grant", "gpl-hope", "lgpl-copy")),
    ("AGPL", ("agpl-grant", "gpl-hope", "agpl-copy")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("0BSD", ("0bsd-grant", "isc-asis")),
    ("Zlib", ("zlib-asis", "zlib-grant", "zlib-origin", "zlib-altered")),
    ("Unlicense", ("unlicense-grant", "unlicense-free")),
    ("Unlicense", ("unlicense-grant",)),
    ("WTFPL", ("wtfpl-copy", "wtfpl-do")),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("CC0-1.0", ("cc0-dedicated", "cc0-asis")),
    ("all-rights-reserved", ("reserved",)),
)


def notices() -> dict[str, str]:
    """Every form of notice for every name and identifier of a licence."""
    out = {}
    for licence, names in NAMES:
        own = licence.lower().replace("-", " ")
        for form in FORMS:
            # A bare name or "the" and a name says too little, unless the name ends so that it is a title.
            wanted = [n for n in names if n.endswith("license")] if form in ("{}", "the {}") else [*names, own, f"{own} license"]
            out |= {form.format(n): f"{licence.lower()}-notice" for n in wanted}
        for suffix in ("", " only", " or later"):
            # In the expression of an SPDX line.
            out.setdefault(own + suffix, f"{licence.lower()}-id")
    return out


#: Ordered: the rule with most identifiers first, so that what a longer rule takes is not left to a shorter one.
RULES = tuple(sorted((*TEXT_RULES, *((licence, (f"spdx:{licence.lower()}-id",)) for licence, _ in NAMES), *((licence, (f"{licence.lower()}-notice",)) for licence, _ in NAMES)), key=lambda r: -len(r[1])))
