"""Licence notices as they are published, each with the words that tell it from its relatives.

Fixed values: (label, text, telling phrases). Telling phrases are runs of
consecutive words that a block must hold besides the share of the text's words.
"""

from __future__ import annotations

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_CONDITION = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE_USE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_NOTICE = (
    f'Licensed under the Apache License, Version 2.0 (the "License"); {_APACHE_USE} Unless required by applicable law or agreed to in writing, software distributed under the License is '
    'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)


def _gnu(kind: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of "
        "the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."
    )


def _gnu_terms(kind: str) -> str:
    return f"redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation"


_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"

TEMPLATES = [
    # Short notices.
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "Released under the Apache License 2.0", ("apache license 2 0",)),
    ("mit", "Released under the MIT License", ("mit",)),
    ("mit", "This project is licensed under the MIT License", ("mit license",)),
    ("bsd", "Released under the BSD License", ("bsd",)),
    ("isc", "Released under the ISC License", ("isc",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license",)),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("attribution 4 0",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("attribution noncommercial 4 0",)),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("attribution noderivatives 4 0",)),
    ("cc-by-nc-sa-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ("attribution noncommercial sharealike 4 0",)),
    # Opening parts, which often stand alone.
    ("apache-2.0", _APACHE_USE, ("apache org", "license 2 0")),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', ("free of charge",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("gpl", _gnu_terms(_GPL), ("gnu general public license",)),
    ("lgpl", _gnu_terms(_LGPL), ("gnu lesser general public license",)),
    ("agpl", _gnu_terms(_AGPL), ("gnu affero general public license",)),
    # Whole texts and notices.
    ("mit", f"{_MIT_GRANT} {_MIT_CONDITION} {_WARRANTY}", ("free of charge",)),
    ("apache-2.0", _APACHE_NOTICE, ("apache license version 2 0",)),
    ("bsd-2-clause", f"{_BSD_CONDITIONS} {_BSD_WARRANTY}", ("source and binary forms",)),
    ("bsd-3-clause", f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_WARRANTY}", ("source and binary forms", "endorse or promote products")),
    ("gpl-2.0", _gnu(_GPL, "2"), ("gnu general public license", "version 2")),
    ("gpl-3.0", _gnu(_GPL, "3"), ("gnu general public license", "version 3")),
    ("lgpl", _gnu(_LGPL, "3"), ("gnu lesser general public license",)),
    ("agpl-3.0", _gnu(_AGPL, "3"), ("gnu affero general public license", "version 3")),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0",),
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
        "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("public domain",),
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software",)),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
        ("must not be misrepresented",),
    ),
]
