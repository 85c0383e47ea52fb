"""Stop words by language (ISO 639-1)."""

from __future__ import annotations

# Common function words of each language.
STOPWORDS = {
    "en": "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your",
    "de": "aber alle als also am an auch auf aus bei bin bis da damit dann das dass dein dem den der des die dies diese dieser dieses doch dort du durch ein eine einem einen einer eines er es für hat haben hier ich ihr im in ist ja jede jeder jetzt kann kein keine man mit muss nach nicht noch nur ob oder ohne sehr sein seine sich sie sind so über um und uns unter vom von vor war was weil wenn wer wie wir wird wo zu zum zur",
    "fr": "à au aux avec ce ces cette comme dans de des du elle en est et être eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ont ou où par pas pour qu que qui sa sans se ses si son sont sur ta te tes toi ton tu un une vos votre vous y",
    "es": "a al algo ante antes como con cuando de del desde donde durante e el ella ellos en entre era es esta este esto fue ha hasta hay la las le les lo los más me mi muy no nos o para pero por porque que qué se ser si sin sobre son su sus también te tiene todo un una uno y ya yo",
    "it": "a ai al alla anche che chi ci come con da dal dalla dei del della di e è era gli ha ho i il in io la le lei lo loro lui ma mi nel nella no noi non o per però più quando quello questa questo qui se sei si sono su sua suo tra tu un una uno vi voi",
    "pt": "a ao aos as até com como da das de do dos e é ela ele em entre era essa esse esta este eu foi há isso já lhe mais mas me mesmo meu minha muito na não nas no nos o os ou para pela pelo por qual quando que quem se sem ser seu só sua são também te um uma você",
    "nl": "aan al alles als ben bij dan dat de der deze die dit doen door dus een en er ge haar had heb hebben heeft hem het hij hoe hun ik in is ja je kan maar me meer men met mij mijn na naar niet nog nu of om onder ons ook op over te tot u uit van veel voor want waren was wat we wel werd wie wij wordt zal ze zich zij zijn zo zonder zou",
    "pl": "a aby ale bez był była było być ci co czy dla do go i ich ile im ja jak jako je jego jej jest już kiedy kto ma mi mnie może na nad nam nas nie nim o od on ona oni po pod przez przy się są ta tak tam te tego ten to tu ty w we wie z za ze że",
}
#: Three-letter codes of the same languages.
SHORT_CODES = {"eng": "en", "deu": "de", "fra": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "pol": "pl"}


def stopwords(language: str) -> list[str]:
    """The stop words of a language, in two or three letters; English where the language has none."""
    code = language.lower()
    return STOPWORDS.get(SHORT_CODES.get(code, code), STOPWORDS["en"]).split()


def label_code(label: str | None) -> str:
    """The code at the start of a language label (``de-AT``, ``deu_x``), in lower case; "" for null."""
    return (label or "").strip().lower().replace("_", "-").partition("-")[0]
