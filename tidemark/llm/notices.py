"""Paragraphs by which licences are named or granted: what the licence classifier learns from and compares with."""

_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."


def _gnu(name: str, short: str, version: str) -> tuple[str, ...]:
    return (
        f"This work is licensed under the GNU {name}, version {version}.",
        _FREE.format(name, version),
        f"SPDX-License-Identifier: {short}-{version}-or-later",
        f"Licensed under the {short} v{version}",
        f"You should have received a copy of the GNU {name} along with this program, version {version}.",
        _WARRANTY.format(f"{name} version {version}"),
        f"Released under the terms of the GNU {name} {version} ({short}-{version})",
    )


def _cc(name: str, short: str, version: str = "4.0") -> tuple[str, ...]:
    return (
        f"Licensed under {short} {version}.",
        f"This work is licensed under a Creative Commons {name} {version} International License",
        f"SPDX-License-Identifier: {short.replace(' ', '-')}-{version}",
        f"Text and images are available under the Creative Commons {name} {version} licence ({short} {version}).",
        f"To view a copy of this license, {name} {version} International, visit creativecommons.org/licenses/{short.split(' ')[-1].lower()}/{version}",
    )


NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "SPDX-License-Identifier: MIT",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license, the 3-clause BSD license",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the New BSD License (three clauses)",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Licensed under the Simplified BSD License (two clauses)",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        _AS_IS,
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "GPL-3.0": _gnu("General Public License", "GPL", "3") + ("SPDX-License-Identifier: GPL-3.0-only", "Licensed under GPL v3"),
    "GPL-2.0": _gnu("General Public License", "GPL", "2") + ("SPDX-License-Identifier: GPL-2.0-only", "Licensed under GPL v2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This work is available under the terms of the Mozilla Public License, version 2.0",
    ),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "CC BY-NC"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "CC BY-SA"),
    "CC-BY-4.0": _cc("Attribution", "CC BY"),
    "CC0-1.0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain under CC0 by waiving all rights to the work worldwide under copyright law.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
    ),
}
#: notices of no family above, with words to be filled in: they teach the class `other`
OTHERS = (
    "All rights reserved.",
    "Licensed under the {} License.",
    "This work is licensed under the {} Public License, version {}.",
    "Released under the terms of the {} licence {}",
    "Use of this file is governed by a {} licence agreement",
    "Permission to use this work is granted by {} only",
    "Copyright {} and contributors, licensed to you under terms of {}",
)
#: notices of licences that are never trained on: the bound for `other` is set with them
UNSEEN = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "This library is free software; you can redistribute it under the Artistic License 2.0",
    "This software is provided as-is, without any express or implied warranty; permission is granted to anyone to use this software for any purpose, the zlib way",
    "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence, version 1.2",
    "Released under the PostgreSQL Licence.",
    "Licensed under the Open Software License version 3.0",
    "This document may be copied under the terms of the GNU Free Documentation License",
)
