"""Templates for license scans: (license id, text).

Words in braces are those by which a license differs from its neighbours: a document must have them all, in a row.
"""

# Whole license texts, notices and names, as their publishers word them.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so")
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT_CONDITION = (
    ", {subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software}. ")
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_CONDITION = ", {provided that the above copyright notice and this permission notice appear in all copies}. "
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_SOURCE = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ")
_BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_BSD_NAMES = (
    "3. {Neither the name} of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. ")
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.")
_BSL = (
    "{Boost Software License} - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization "
    'obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
    "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
    "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the "
    "above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and "
    "all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
    "generated by a source language processor.")
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
    "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
    "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.")
_APACHE_NOTICE = (
    'Licensed under the {Apache License, Version 2}.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")
_APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
    "limitations under the License.")
_GNU_NOTICE = (
    "you can redistribute it and/or modify it under the terms of the {{GNU {name}}} as published by the Free Software Foundation, either "
    "{{version {version}}} of the License, or (at your option) any later version.")
_GNU = (
    ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"),
    ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"))
_CREATIVE = (
    ("CC-BY", "BY", "Attribution"), ("CC-BY-SA", "BY-SA", "Attribution-ShareAlike"), ("CC-BY-ND", "BY-ND", "Attribution-NoDerivatives"),
    ("CC-BY-NC", "BY-NC", "Attribution-NonCommercial"), ("CC-BY-NC-SA", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-NC-ND", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_SPDX = (
    "Apache-2.0", "MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1",
    "LGPL-3.0", "MPL-2.0", "EPL-2.0", "Artistic-2.0", "CC0-1.0")

#: ``X-style``: the opening of X alone, without the conditions that make it X.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT + _MIT_CONDITION + _MIT_WARRANTY),
    ("MIT-0", _MIT_GRANT + ". " + _MIT_WARRANTY),
    ("MIT-style", _MIT_GRANT.split("(the")[0]),
    ("MIT", "Released under the {MIT License}"),
    ("MIT", "Licensed under the {MIT License}"),
    ("ISC", _ISC_GRANT + _ISC_CONDITION + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ". " + _ISC_WARRANTY),
    ("ISC-style", _ISC_GRANT),
    ("BSD-2-Clause", _BSD_OPENING + _BSD_SOURCE + _BSD_BINARY + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_OPENING + _BSD_SOURCE + _BSD_BINARY + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-style", _BSD_OPENING),
    ("Zlib", _ZLIB), ("BSL-1.0", _BSL), ("Unlicense", _UNLICENSE),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Apache-2.0", _APACHE_NOTICE + _APACHE_REST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the {Apache License, Version 2}.0"),
    *((i, f"This program is free software: {_GNU_NOTICE.format(name=name, version=version)}") for i, name, version in _GNU),
    *((i, f"This work is licensed under the {{GNU {name}, version {version}}}") for i, name, version in _GNU),
    *((i, f"Licensed under the {{GNU {name} v{version}}}") for i, name, version in _GNU),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2}.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2}.0"),
    ("Artistic-2.0", "Licensed under the {Artistic License 2}.0"),
    ("CC0-1.0", "released into the public domain under {CC0 1}.0"),
    *((f"{i}-4.0", f"Licensed under {{CC {short} 4.0}}") for i, short, _ in _CREATIVE),
    *((f"{i}-4.0", f"This work is licensed under a {{Creative Commons {long} 4.0}} International License") for i, _, long in _CREATIVE),
    *((i, f"{{SPDX-License-Identifier: {i}}}") for i in _SPDX),
    ("all-rights-reserved", "All rights reserved"),
)
