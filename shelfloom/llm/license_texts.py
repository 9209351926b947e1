"""Passages of well-known licences and their usual notices.

Each is (label, key phrase, passage). A passage is one that stands in a file without a break, so that its
words keep their distances; the key phrase must stand in it.
"""

from __future__ import annotations

TEMPLATES = (
    ("mit", "mit license", "Released under the MIT License"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    (
        "mit",
        "to deal in the software without restriction",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "mit",
        "authors or copyright holders",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
    ),
    ("apache", "apache license", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "apache license",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
    ),
    (
        "apache",
        "software distributed under the license",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ),
    ("gpl", "general public license", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "general public license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    (
        "gpl",
        "gnu general public license for more details",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
    ),
    (
        "lgpl",
        "lesser general public license",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    (
        "agpl",
        "affero general public license",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "bsd",
        "redistributions in binary form must reproduce",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution",
    ),
    (
        "bsd",
        "may be used to endorse or promote products",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    (
        "isc",
        "the author disclaims all warranties",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER",
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions",
    ),
    (
        "boost",
        "to any person or organization obtaining a copy",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    ("mpl", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "cc by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "creative commons attribution noncommercial", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "public domain dedication", "Licensed under the CC0 1.0 Universal Public Domain Dedication"),
    ("unlicense", "unencumbered software", "This is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license", "Do What The Fuck You Want To Public License"),
)
