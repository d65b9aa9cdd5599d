"""Openings of public licence texts and the phrases each must contain."""

#: label -> (notice texts, key phrases of which all must stand in place; both in lower-case words)
TEMPLATES: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "agpl": [("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
              "as published by the free software foundation", ("affero general public license",))],
    "apache": [("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                "you may obtain a copy of the license at", ("apache license", "except in compliance")),
               ("licensed under the apache license version 2 0", ("apache license",))],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
             "conditions are met", ("source and binary forms",))],
    "cc-by-nc": [("licensed under cc by nc 4 0", ("cc by nc",)),
                 ("creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",))],
    "cc-by-sa": [("licensed under cc by sa 4 0", ("cc by sa",)),
                 ("creative commons attribution sharealike 4 0 international license", ("attribution sharealike",))],
    "gpl": [("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
             "as published by the free software foundation", ("gnu general public license",)),
            ("this work is licensed under the gnu general public license version 3", ("gnu general public license",))],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("with or without fee",))],
    "mit": [("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
             "the software to deal in the software without restriction", ("hereby granted free of charge", "without restriction")),
            ("released under the mit license", ("mit license",)), ("licensed under the mit license", ("mit license",))],
    "mpl": [("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",))],
    "unlicense": [("this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain"))],
}

#: Words of the templates that are left out of every index because any prose holds them.
STOP_WORDS = frozenset("a an and any are as at be by can for forms from in into is it may not of on or that the this to under v with you 0 2 3 4".split())
