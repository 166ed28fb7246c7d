"""Word lists, names and limits that results depend on."""

from __future__ import annotations

# Given names by nickname.
NICKNAMES = {
    "bob": "robert", "bill": "william", "will": "william", "billy": "william", "rob": "robert", "bobby": "robert", "rich": "richard",
    "dick": "richard", "rick": "richard", "ricky": "richard", "mike": "michael", "mick": "michael", "mickey": "michael", "jim": "james",
    "jimmy": "james", "jamie": "james", "jack": "john", "johnny": "john", "jon": "john", "chris": "christopher", "kate": "katherine",
    "kathy": "katherine", "cathy": "catherine", "cat": "catherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth",
    "lisa": "elizabeth", "dave": "david", "davy": "david", "dan": "daniel", "danny": "daniel", "nick": "nicholas", "nicky": "nicholas",
    "pete": "peter", "mat": "matthew", "matt": "matthew", "steve": "steven", "steph": "stephanie", "sue": "susan", "susie": "susan",
    "sam": "samuel", "al": "albert", "alex": "alexander", "tony": "anthony", "andy": "andrew", "drew": "andrew", "jen": "jennifer",
    "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles",
    "tom": "thomas", "tommy": "thomas", "tim": "timothy", "timmy": "timothy", "fred": "frederick", "freddy": "frederick", "frank": "francis",
    "francesca": "frances", "fran": "frances", "pat": "patricia", "pam": "pamela", "deb": "deborah", "debbie": "deborah",
    "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "amy": "amelia", "emmy": "emily",
}

# Words that tell what a screenshot shows, in order of precedence.
RECEIPT = ("total", "subtotal", "receipt", "tax", "payment", "order #", "invoice", "amount due", "tip")
BOARDING = ("boarding pass", "gate", "seat", "flight", "departure", "arrival", "passenger", "terminal")
COUPON = ("% off", "discount", "promo", "coupon", "code:", "redeem", "expires", "save $", "offer")
MEME = ("when you", "me:", "them:", "nobody:", "literally", "be like")
MESSAGING = ("read", "delivered", "typing", " am", " pm")
SCREENSHOT_TAGS = ("Receipt", "Boarding Pass", "Coupon / Code", "Meme", "Conversation", "Other")

# Identifier prefixes of each category, in order of precedence.
CATEGORY_PREFIXES = {
    "Food & Drink": ("food", "drink", "meal", "snack", "fruit", "vegetable", "bakery", "restaurant"),
    "Pets & Animals": ("animal", "dog", "cat", "bird", "pet", "wildlife", "insect", "fish"),
    "Nature & Outdoors": ("outdoor", "nature", "sky", "water", "mountain", "forest", "beach", "plant", "flower", "landscape"),
    "Documents & Receipts": ("text", "document", "receipt", "paper", "book", "label"),
    "Architecture": ("architecture", "building", "interior", "church", "bridge", "cityscape"),
    "Vehicles": ("vehicle", "car", "motorcycle", "bicycle", "airplane", "boat", "train"),
}

# Signs of wasted shots.
SCREENS = ("television", "monitor", "screen", "laptop", "computer", "cellular_telephone", "desktop_computer", "notebook")
WATERMARKS = ("tiktok", "repost", "forwarded", "via @", "share this", "follow me", "dm for credit")
REASONS = ("darkShot", "qrCode", "screenPhoto", "whiteboard", "memeForwarded", "eyesClosed", "blurryPhoto", "noSubject", "lowLight", "sharedPhoto")

# Bits of media subtypes.
PANORAMA, SCREENSHOT, LIVE, DEPTH = 1, 4, 8, 16

#: First lines of the test screenshots.
SCREENSHOT_WORDS = ("total", "gate", "coupon", "me:", "delivered", "typing", "hello", "repost", "offer", "seat", "invoice", "literally")

# Sizes, gaps and limits.
LARGE_FILE = 52_428_800
LARGE_PHOTO = 10_485_760
BLURRY_BYTES, SCREENSHOT_BYTES = 3_000_000, 200_000
ROLL_GAP_S, ROLL_KM, ROLL_ITEMS, ROLL_SPAN_S = 1_800, 1.0, 5, 300
SIMILAR, NEAR, KEYFRAME, HASH_BITS = 0.5, 0.12, 0.35, 3
FRESH_S = 1.0
PRIORITY = {"exactDuplicate": 3, "nearDuplicate": 2, "burstShot": 1, "visuallySimilar": 0}
PRESETS = (("low", 0.30), ("medium", 0.55), ("high", 0.90))
