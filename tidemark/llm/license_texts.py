"""Public licence texts by which licences are recognised.

Each is (licence, anchor, text): a one-line notice, a header notice, a whole short licence, or the
head of a long one. The anchor is a word of the text that places it in a file.
"""

from __future__ import annotations

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_GNU_COPYING = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GNU_WARRANTY = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""


def _gnu(kind: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published
by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. {_GNU_WARRANTY.format(kind=kind)}"""


TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("all-rights-reserved", "reserved", "All rights reserved."),
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
        the License.""",
    ),
    (
        "apache-2.0",
        "apache",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
        DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
        Sections 1 through 9 of this document.""",
    ),
    ("bsd-2-clause", "merchantability", f"{_BSD_GRANT} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("bsd-3-clause", "merchantability", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("cc-by-4.0", "cc", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "cc", "Licensed under CC BY-NC 4.0."),
    ("gpl-2.0", "gnu", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_GNU_COPYING}"),
    ("gpl-2.0", "gnu", _gnu("General Public License", "2")),
    ("gpl-3.0", "gnu", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "gnu", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_GNU_COPYING}"),
    ("gpl-3.0", "gnu", _gnu("General Public License", "3")),
    ("agpl-3.0", "gnu", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_GNU_COPYING}"),
    ("agpl-3.0", "gnu", _gnu("Affero General Public License", "3")),
    ("lgpl-3.0", "gnu", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_GNU_COPYING}"),
    ("lgpl-3.0", "gnu", _gnu("Lesser General Public License", "3")),
    (
        "isc",
        "permission",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    ("mit", "mit", "Released under the MIT License."),
    ("mit", "merchantability", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("mpl-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "mpl-2.0",
        "mozilla",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    (
        "mpl-2.0",
        "mozilla",
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
        contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions
        of others (if any) used by a Contributor and that particular Contributor's Contribution.""",
    ),
    (
        "unlicense",
        "unencumbered",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    ),
)
