"""Phrases and model-output cases laid over the given conversations.

A turn gets phrase ``(conv_id * 7 + turn * 3) % 24``; the next turn therefore gets the phrase three further,
so requests, proposals and greetings are answered.
"""

PHRASES = [  # (number, text, is the whole line)
    (0, "Can you check the upload by Friday?", False),
    (1, "Should we go with the second option?", False),
    (2, "Hi Sara, can you hear me?", False),
    (3, "Sure, I'll do it tomorrow.", True),
    (4, "Agreed.", True),
    (5, "Yes, I'm Sara and I can hear you.", False),
    (6, "I am Priya and I will send 15 slides.", False),
    (7, "Let's go with the blue design, that's final.", False),
    (8, "Thanks Sara, over to Arjun.", False),
    (9, "Hello Priya, please review the Pie Torch model.", False),
    (10, "Maybe we could postpone the launch.", False),
    (11, "Hello Priya, this is Arjun, send it to report dot pdf.", False),
    (12, "We should not ship fifteen builds before Monday.", False),
    (13, "Sounds good, let's do that.", True),
    (14, "Arjun here, we cannot use see you da kernels without tests.", False),
    (15, "Okay.", True),
    (16, "We decided on fifty percent, it is never going back.", False),
    (17, "It might work, nothing is confirmed.", False),
    (18, "The deadline is next Tuesday, don't wait.", False),
    (19, "What if we try user underscore id instead?", False),
    (20, "Could you mail sara dot k at the rate gmail dot com?", False),
    (21, "Rahul said the Guhati team needs to finish 2,500 tests.", False),
    (22, "Fair enough, Whisper is fine by me.", True),
    (23, "Absolutely, the cost is 2.5 million.", False),
]

EDITS = [  # (phrase, k, original, replacement, category, confidence in percent, line offset)
    (0, 0, "upload", "upload of every single recording we ever made this year", "technical_term", 90, 0),
    (0, 1, "Can you check", "Did they break", "homophone", 50, 0),
    (1, 0, "second option", "second Option", "product", 80, 0),
    (2, 0, "Sara", "Zara", "proper_noun", 95, 0),
    (3, 0, "tomorrow", "tomorow", "homophone", 65, 0),
    (3, 1, "I'll", "I would", "homophone", 90, 0),
    (4, 0, "Agreed", "Aggrieved", "homophone", 72, 0),
    (5, 0, "can hear", "cannot hear", "homophone", 90, 0),
    (6, 0, "15 slides", "50 slides", "homophone", 90, 0),
    (6, 1, "Priya", "Riya", "proper_noun", 95, 0),
    (7, 0, "blue design", "green layout", "homophone", 90, 0),
    (8, 0, "over to Arjun", "over to arjun", "proper_noun", 80, 0),
    (8, 1, "to Arjun", "To Arjun", "proper_noun", 90, 0),
    (9, 0, "Pie Torch", "PyTorch", "technical_term", 90, 0),
    (9, 1, "Pie Torch model", "PyTorch model", "technical_term", 75, 0),
    (10, 0, "launch", "lunch", "homophone", 80, 900),
    (11, 0, "report dot pdf", "report.pdf", "symbol", 90, 0),
    (12, 0, "should not ship", "should ship", "homophone", 90, 0),
    (12, 1, "fifteen", "15", "homophone", 90, 0),
    (12, 2, "should", "Should", "homophone", 90, 0),
    (14, 0, "see you da", "CUDA", "acronym", 80, 0),
    (14, 1, "kernels", "colonels", "homophone", 90, 0),
    (16, 0, "missing words", "some words", "homophone", 90, 0),
    (17, 0, "might", "may", "homophone", 90, 0),
    (18, 0, "don't wait", "do not wait", "homophone", 90, 0),
    (19, 0, "user underscore id", "user_id", "symbol", 90, 0),
    (20, 0, "sara", "Sara", "proper_noun", 90, 0),
    (21, 0, "Guhati", "Guwahati", "proper_noun", 90, 0),
    (21, 1, "2,500", "2,600", "homophone", 95, 0),
    (21, 2, "Rahul", "Raul", "proper_noun", 95, 0),
    (22, 0, "fine", "fine ", "homophone", 90, 0),
    (22, 1, "Whisper", "Wisper", "product", 90, 0),
    (23, 0, "Absolutely", "absolutely", "homophone", 90, 0),
]

SENTENCES = [  # (phrase, k, section, topic, text, cited line offsets)
    (0, 0, "summary", "", "Someone asked for the upload check by Friday.", [0]),
    (2, 0, "minutes", "Opening", "Sara was greeted.", [0]),
    (3, 0, "summary", "", "The check was promised for Monday.", [0]),
    (6, 0, "summary", "", "A set of 15 slides was promised by Priya.", [0]),
    (6, 1, "minutes", "Slides", "Fifty slides were promised.", [0]),
    (7, 0, "minutes", "Design", "The blue design was chosen.", [0, 1]),
    (9, 0, "minutes", "Models", "The team reviewed Pie Torch with Priya.", [0, 0]),
    (11, 0, "minutes", "Files", "The report came from Arjun.", [-1]),
    (12, 0, "summary", "", "At most 15 builds ship before Monday.", [0]),
    (12, 1, "minutes", "Builds ", "Builds wait for Monday and 15 slides.", [0, 900]),
    (15, 0, "minutes", "Dates", "The deadline is Tuesday.", [0]),
    (16, 0, "summary", "", "It was decided on 50 percent.", [0]),
    (18, 0, "minutes", "dates", "Speaker 1 warned about Tuesday.", [0]),
    (20, 0, "summary", "", "Nobody cited this.", []),
    (21, 0, "minutes", "tests", "Rahul wants 2500 tests in Guhati.", [0]),
    (23, 0, "minutes", "Costs", "The cost is 3.5 million.", [0]),
    (23, 1, "minutes", "Costs", "The cost is 25 million for Whisper.", [0]),
]

DECISIONS = [  # (phrase, k, decision, agreement evidence, cited line offsets)
    (1, 0, "Use the second option", "Agreed.", [0, 1]),
    (1, 1, "Take the second option", "we all agreed strongly on it", [0]),
    (5, 0, "Nothing", "agreed", [900]),
    (7, 0, "Blue design", "Let's go with the blue design", [0]),
    (10, 0, "Postpone the launch", "maybe postpone", [0]),
    (16, 0, "Fifty percent", "We decided on fifty percent", [0, -1]),
    (18, 0, "Deadline next Tuesday", "deadline is next Tuesday", [0]),
    (19, 0, "Try underscore ids", "it was decided by all", [0]),
    (22, 0, "Whisper stays", "everyone confirmed", [0, 900]),
]

PROPOSALS = [  # (phrase, k, proposal, cited line offsets)
    (1, 0, "Second option", [0, 1]),
    (10, 0, "Postpone launch", [0]),
    (13, 0, "None", [900]),
    (19, 0, "Try user ids", [0]),
]

TASKS = [  # (phrase, k, task, quote, owner offset, owner words, deadline offset, deadline words, cited offsets)
    (0, 0, "Check the upload", "Can you check the upload by Friday", None, None, 0, "Friday", [0]),
    (0, 1, "Look at upload", "look at the upload soon please", None, None, 1, "tomorrow", [0]),
    (3, 0, "Do the check", "I'll do it tomorrow", 0, "I", 0, "Tomorrow", [0]),
    (6, 0, "Send slides", "I will send 15 slides", 0, "Priya", 2, "Monday", [0]),
    (6, 1, "Send the deck", "send 15 slides", 4, "Bob", 3, "Friday", [0]),
    (9, 0, "Review model", "please review the Pie Torch model", -1, "Priya", None, None, [0]),
    (9, 1, "Review it all", "please review the Pie Torch model", -1, "Priya", 4, "Monday", [0, 1]),
    (12, 0, "Hold builds", "We should not ship fifteen builds", 0, "We", 0, "", [0]),
    (14, 0, "Write tests", "unrelated text here", None, None, None, None, [0]),
    (20, 0, "Mail Sara", "Could you mail sara", None, None, 900, "x", [0, 900]),
    (21, 0, "Finish tests", "needs to finish 2,500 tests", 0, "Rahul", None, None, [0]),
]

NAMES = [  # (phrase, k, label, name)
    (2, 0, "Speaker 1", "Sara"), (2, 1, "Speaker 2", "Sara"), (5, 0, "Speaker 1", "Sara"),
    (5, 1, "Speaker 2", "Sara"), (6, 0, "Speaker 1", "Priya"), (6, 1, "Speaker 2", "Priya"),
    (8, 0, "Speaker 1", "Arjun"), (9, 0, "Speaker 2", "Priya"), (14, 0, "Speaker 1", "Arjun"),
    (14, 1, "Speaker 2", "Arjun"), (14, 2, "Speaker 2", "Python"), (22, 0, "Speaker 1", "Whisper"),
]

FIXES = [  # (phrase, k, speaker)
    (4, 0, "Speaker 2"), (4, 1, "Speaker 1"), (12, 0, "Speaker 1"), (13, 0, "Speaker 9"), (15, 0, "Speaker 2"),
]

VOCABULARY = [  # (phrase, k, domain, term, heard as, cited line offsets)
    (9, 0, "ml", "PyTorch", ["Pie Torch"], [0]),
    (12, 0, "ops", "pytorch", ["pie torch", "py torch"], [0]),
    (14, 0, "", " CUDA ", ["see you da"], [0, -1]),
    (18, 0, "", " ", [], [0]),
    (21, 0, "", "Guwahati", ["Guhati"], [0]),
    (23, 0, "finance", "Budget", [], [0]),
]

GLOSSARY = ["cuda", "Kubernetes ", ""]
