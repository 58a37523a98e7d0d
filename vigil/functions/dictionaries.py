"""Word lists and tables that the scoring rules read."""

# The lists below are part of the scoring semantics.
SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "work", "click", "loan", "win", "download", "review", "country", "kim", "science", "party", "gdn", "online", "site", "website", "space", "fun", "icu", "cyou", "buzz", "rest", "monster", "quest", "sbs", "cfd", "bond"]
COMMON_TLDS = ["com", "net", "org", "edu", "gov", "int", "mil", "id", "co.id", "ac.id", "go.id", "or.id", "sch.id", "web.id", "my.id", "co.uk", "de", "jp", "fr", "au", "ca", "nl", "it", "es", "se", "io", "dev", "app", "co"]
PHISHING_WORDS = ["login", "signin", "verify", "secure", "account", "update", "confirm", "password", "webscr", "ebayisapi", "suspend", "billing", "invoice", "unlock", "recover", "validation", "authenticate", "wallet", "support", "service", "customer"]
GAMBLING_WORDS = ["slot", "gacor", "maxwin", "toto", "togel", "judi", "casino", "kasino", "poker", "domino", "bandar", "sbobet", "pragmatic", "pgsoft", "jackpot", "jekpot", "zeus", "olympus", "scatter", "rungkad", "depo", "wede", "withdraw", "jp", "rtp", "hoki", "cuan", "betting", "taruhan", "dadu", "roulette", "baccarat", "mpo", "pkv", "qq", "bola88", "situs", "resmi", "terpercaya", "gampang", "bonus", "freebet", "parlay", "mixparlay", "sultan", "petir"]
STRONG_GAMBLING_WORDS = ["slot", "gacor", "maxwin", "togel", "toto", "judi", "sbobet", "pragmatic", "rungkad", "pkv", "scatter", "jekpot", "casino", "kasino"]
SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "adf.ly", "shorte.st", "cutt.ly", "s.id", "bit.do", "rebrand.ly", "rb.gy"]
BRANDS = {
    "google": "google.com", "paypal": "paypal.com", "amazon": "amazon.com", "microsoft": "microsoft.com", "apple": "apple.com", "facebook": "facebook.com",
    "instagram": "instagram.com", "netflix": "netflix.com", "whatsapp": "whatsapp.com", "linkedin": "linkedin.com", "dropbox": "dropbox.com", "steam": "steampowered.com",
    "telegram": "telegram.org", "discord": "discord.com", "spotify": "spotify.com", "tiktok": "tiktok.com", "twitter": "twitter.com", "binance": "binance.com",
    "coinbase": "coinbase.com", "metamask": "metamask.io", "roblox": "roblox.com", "minecraft": "minecraft.net", "garena": "garena.com", "freefire": "ff.garena.com",
    "bri": "bri.co.id", "bca": "bca.co.id", "mandiri": "bankmandiri.co.id", "bni": "bni.co.id", "bsi": "bankbsi.co.id", "cimb": "cimbniaga.co.id",
    "gopay": "gopay.co.id", "ovo": "ovo.id", "dana": "dana.id", "shopee": "shopee.co.id", "tokopedia": "tokopedia.com", "bukalapak": "bukalapak.com", "traveloka": "traveloka.com",
    "gojek": "gojek.com", "grab": "grab.com", "linkaja": "linkaja.id", "blibli": "blibli.com", "lazada": "lazada.co.id", "seabank": "seabank.co.id",
    "jenius": "jenius.com", "prakerja": "prakerja.go.id", "bpjs": "bpjs-kesehatan.go.id", "samsat": "samsat.info",
}
FREE_HOSTING = ["pages.dev", "vercel.app", "netlify.app", "github.io", "web.app", "firebaseapp.com", "repl.co", "replit.app", "glitch.me", "workers.dev", "r2.dev", "cleverapps.io", "weebly.com", "weeblysite.com", "blogspot.com", "wixsite.com", "herokuapp.com", "000webhostapp.com", "serv00.net", "framer.app", "framer.website", "webflow.io", "surge.sh", "onrender.com", "azurewebsites.net", "pythonanywhere.com", "githubusercontent.com"]
PATH_WORDS = ["login", "signin", "verify", "verification", "secure", "account", "update", "confirm", "password", "webscr", "wp-admin", "wp-login", "banking", "unlock", "suspended", "recovery", "authenticate"]
FAKE_INNER_SUFFIXES = ["com", "net", "org", "co", "gov", "edu"]
