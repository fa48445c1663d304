"""Fixed values of the search of residue: trusted examples, one a line, and words that are alike in residue."""

TRUSTED = {
    "placeholder": """
{{ title }}
{{ summary }}
{{due_date}}
{{file.name}}
{{ project | upper }}
{{date:YYYY-MM-DD}}
<% tp.title %>
<%= title %>
<% file.name %>
{% block title %}
{% date %}
{% include header %}
%(title)s
%(first_name)s
%(file.title)s
%TITLE%
%DUE_DATE%
%NAME%
$TITLE$
$DUE_DATE$
$NAME$
${title}
${date:YYYY-MM-DD}
${due_date}
${file.name}
#{title}
#{due_date}
#{file.name}
{title}
{due_date}
{file.name}
{date:YYYY-MM-DD}
{time:HH-MM}
@@TITLE@@
@@DUE_DATE@@
@@name@@
__TITLE__TODO__
__DUE_DATE__TODO__
__NAME__TODO__
XX_TITLE_XX
XX_DUE_DATE_XX
XX_NAME_XX
<<title>>
<<due_date>>
<<first name>>
[[title:FILL]]
[[due date:FILL]]
[[name: FILL]]
[Insert title here]
[insert due date here]
[Insert name here]
[insert title]
[enter name]
[Enter due date]
[add title]
[add your text here]
[your name]
[your first name here]
[put title here]
[write summary here]
[fill in title]
[title goes here]
[due date goes here]
[summary goes here]
<your title>
<your first name>
<your name here>
<insert title here>
<insert due date>
<enter title>
(enter title)
(enter due date)
(insert name)
(fill in title)
(fill in due date)
(add your name)
[Titel einfügen]
[Name einfügen]
[Datum hier einfügen]
[Datum eintragen]
<Titel einsetzen>
[insérer le titre]
[insérer la date ici]
[titre à remplir]
[saisir le titre]
[insertar título]
[insertar la fecha aquí]
[rellenar nombre]
[completar fecha]
INSERT TEXT
INSERT TITLE
INSERT TEXT HERE
ENTER NAME
ENTER TITLE HERE
ADD TEXT
ADD CONTENT HERE
TITLE HERE
NAME HERE
SUMMARY HERE
YYYY-MM-DD
DD.MM.YYYY
MM/DD/YYYY
Firstname Lastname
First name Last name
FirstName LastName
Status: xxx
Date: xxxx
Name: xxxxx
Status: ____
Date: ________
Name: _____
Status: ???
Date: ????
Status: (optional)
Date: (optional)
""",
    "filler": """
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco.
test test test
asdf asdf asdf
blah blah blah
tbd tbd tbd
foo foo foo
todo todo
Your text here.
Your text goes here.
Your content here.
Your content goes here.
Your heading here.
Your title goes here.
Add your text here.
Add text here.
Add content here.
Insert text here.
Insert your text here.
Insert content here.
Sample text
Sample text sample text
Sample text. Sample text. Sample text.
This is sample text.
This is a sample text.
This is placeholder text.
This is dummy text.
Dummy text
Dummy heading
Dummy heading here.
Dummy content
Placeholder text
Placeholder heading
Placeholder image
Placeholder paragraph, content to follow.
Placeholder text, content to follow.
Placeholder paragraph, text coming soon.
Content coming soon.
Content to follow.
Text to be added.
Description goes here.
Description goes here, replace me later.
Text goes here, replace this later.
Title goes here.
Body goes here.
Summary goes here.
Replace me later.
Replace this text later.
Replace this later.
Replace me.
Type something.
Type something here.
Type something...
Type here.
Start typing here.
Start typing.
Start typing your note.
Write something here.
Write something.
Write here.
Write your note here.
Write your text here.
Enter your text here.
Click to edit.
Click here to edit.
Click to add text.
Click to edit paragraph.
Click to add paragraph.
Click to edit title.
Click here to add title.
Click to add title.
Click to enter text.
Beispieltext
Blindtext
Hier steht Ihr Text.
Hier steht der Text.
Hier kommt Ihr Text.
Texte d'exemple.
Votre texte ici.
Texto de ejemplo.
Texto de relleno.
Su texto aquí.
Tu texto aquí.
""",
    "error": """
Error 404
Error 500.
Error: 7f3a
Error code 404
Error code: 500
ERROR CODE 7f3a
Fehler 404
Fehler 500.
Fehlercode 404
Fehlercode: 12
Erreur 404
Erreur 500.
Code d'erreur 404
Código de error 404
Código de error: 500
400 Bad Request
401 Unauthorized
401 Unauthorised
402 Payment Required
403 Forbidden
404 Not Found
405 Method Not Allowed
406 Not Acceptable
408 Request Timeout
408 Request Timed Out
408 Timed Out
409 Conflict
410 Gone
429 Too Many Requests
500 Internal Server Error
500 Internal Error
500 Server Error
501 Not Implemented
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
504 Gateway Timed Out
The server answered with 400 Bad Request.
The server answered with 401 Unauthorized.
The server answered with 401 Unauthorised.
The server answered with 402 Payment Required.
The server answered with 403 Forbidden.
The server answered with 404 Not Found.
The server answered with 405 Method Not Allowed.
The server answered with 408 Request Timeout.
The server answered with 408 Timed Out.
The server answered with 409 Conflict.
The server answered with 410 Gone.
The server answered with 429 Too Many Requests.
The server answered with 500 Internal Server Error.
The server answered with 500 Internal Error.
The server answered with 501 Not Implemented.
The server answered with 502 Bad Gateway.
The server answered with 503 Service Unavailable.
The server answered with 504 Gateway Timeout.
The server answered with 504 Gateway Timed Out.
Access denied.
Access denied!
ACCESS DENIED
You may not open this page.
You may not view the document.
You may not edit this file.
You do not have permission to view this page.
You do not have permission to open the file.
You don't have permission to access this page.
You don't have access to view this page.
You have reached the limit of requests for this page.
You have reached the limit of requests for the document.
You have exceeded the limit of requests for this file.
You have exceeded the limit of requests.
Request blocked.
Request blocked, reference 12.
Request blocked, reference 7f3a.
Slow down.
Please slow down.
Please slow down!
Something went wrong.
Something went wrong!
Something went wrong while loading this page.
Something went wrong while opening the document.
Something went wrong while rendering this file.
An error occurred.
An error has occurred.
An unexpected error occurred.
An unexpected error has occurred.
An error occurred while loading this page.
An error occurred while opening the document.
A problem occurred.
A problem has occurred.
Down for maintenance.
Down for maintenance!
Down for maintenance, this page will be back soon.
Down for maintenance, the document will be back soon.
Down for maintenance, this site will be back soon.
Cannot connect to the server.
Cannot connect to the database.
Cannot connect to the server, attempt 3.
Cannot connect to the database, attempt 4.
Cannot connect to the index, attempt 2.
Cannot connect to the index.
Could not connect to the server.
Could not connect to the database.
Unhandled exception.
Unhandled exception!
Unhandled exception in view renderer near line 12.
Unhandled exception in view renderer near line 7.
Unhandled exception in module loader near line 12.
Session has expired.
Your session has expired.
Your session has expired, sign in again to view the page.
Your session has expired, sign in again to open this document.
Your session has expired, sign in again.
Your session has expired, please sign in again.
The page could not be found.
Sorry, the page can not be found.
This document cannot be found.
The page could not be loaded.
This document cannot be loaded.
The file can not be loaded.
The page could not be opened.
This document cannot be opened.
The image could not be displayed.
The page cannot be displayed.
The server could not be reached.
The site cannot be reached.
The page cannot be shown to you.
This document cannot be shown to you.
The file cannot be shown to you.
The page does not exist.
This document doesn't exist.
Sorry, this file does not exist.
The page no longer exists.
This document no longer exists.
Oops, the file no longer exists.
The page is gone.
Nothing here: this document is gone.
Sorry, the file is gone.
The page is no longer available.
This document is no longer available.
The link is no longer valid.
This link is no longer valid.
The page is not available.
The page is not available right now.
This document is not available right now.
Sorry, this file is not available right now.
The link is not valid.
This link is not valid.
The page took too long to respond.
The page took too long to open.
This document took too long to load.
Sorry, the file took too long to open.
The page is unavailable.
The page is temporarily unavailable.
This document is currently unavailable.
The page failed to load.
The image failed to load.
This document failed to open.
The page has been moved.
The page has been deleted.
The page has been removed.
The page has been moved or deleted.
This document has been moved or deleted.
The file has been deleted or moved.
This document has been removed or deleted.
The page was moved or deleted.
This document was moved or deleted.
Sorry, the file was moved or deleted.
The page was deleted or moved.
The file was removed or deleted.
The link has expired.
This link expired.
This page has expired.
The document at this address could not be found.
The page at this address could not be found.
The file at this address could not be found.
The document at this address does not exist.
The document at this address is gone.
The document at this address is not available right now.
The document at this address took too long to open.
The document at this address cannot be shown to you.
The document at this address was moved or deleted.
The page behind this link could not be found.
The document behind this link could not be found.
The page behind this link does not exist.
The document behind this link is gone.
The document behind this link is not available right now.
The page behind this link took too long to open.
The page behind this link cannot be shown to you.
The page behind this link was moved or deleted.
The page you asked for could not be found.
The document you requested could not be found.
The page you are looking for could not be found.
The page you are looking for does not exist.
The document you are looking for has been moved.
The page you asked for does not exist.
The page you asked for is gone.
The document you asked for is not available right now.
The page you asked for took too long to open.
The document you asked for cannot be shown to you.
The page you asked for was moved or deleted.
The page you asked for is missing.
The page you requested is missing.
The document you tried to open is missing.
Sorry!
We are sorry.
Oops!
Oh no!
Uh-oh!
Whoops!
Try again later.
Please try again later.
Try again later or go back to the start page.
Please try again later or go back to the start page.
Try again later or go back to the list.
If this keeps happening, contact the administrator.
If this keeps happening, write to the administrator.
If this keeps happening, write to whoever runs the vault.
If this keeps happening, write to whoever runs the site.
If this keeps happening, contact whoever runs the site.
Checking that you are not a robot.
Checking that you are not a robot before we load the page.
Checking that you are not a robot before we open this document.
Verify that you are not a robot.
Verify you are human.
Please verify that you are human.
Zugriff verweigert.
Zugriff verweigert!
Interner Fehler, Kennung 12.
Interner Fehler, Kennung 7f3a.
Bitte später erneut versuchen.
Bitte später erneut versuchen!
Die Seite wurde nicht gefunden.
Das Dokument wurde nicht gefunden.
Die Seite wurde gelöscht.
Das Dokument wurde entfernt.
Die Seite wurde gelöscht oder verschoben.
Das Dokument wurde gelöscht oder verschoben.
Die Datei wurde verschoben oder gelöscht.
Die Seite ist zurzeit nicht erreichbar.
Das Dokument ist derzeit nicht erreichbar.
Die Datei ist momentan nicht verfügbar.
Die Seite ist nicht mehr verfügbar.
Die Seite ist nicht verfügbar.
Die Seite ist nicht erreichbar.
Der Link ist nicht mehr gültig.
Dieser Link ist abgelaufen.
Die Seite existiert nicht.
Das Dokument existiert nicht mehr.
Die Seite konnte nicht geladen werden.
Die Datei konnte nicht gefunden werden.
Die Datei konnte nicht geöffnet werden.
Ihre Sitzung ist abgelaufen.
Ihre Sitzung ist abgelaufen, bitte neu anmelden.
Ihre Sitzung ist abgelaufen, bitte erneut anmelden.
Ein Fehler ist aufgetreten.
Ein interner Fehler ist aufgetreten.
Ein unerwarteter Fehler ist aufgetreten.
Accès refusé.
Accès refusé, veuillez vous reconnecter.
Accès refusé ! Veuillez vous reconnecter.
Veuillez vous reconnecter.
Veuillez réessayer.
Veuillez réessayer plus tard.
Merci de réessayer.
Merci de réessayer plus tard.
La page est momentanément indisponible.
Le document est actuellement indisponible.
Cette page est temporairement indisponible.
La page est indisponible.
La page est introuvable.
Le document est introuvable.
Cette page est inaccessible.
La page n'existe pas.
La page n'existe plus.
Le lien n'est plus valide.
Ce lien n'est pas valide.
Cette page n'est plus disponible.
Cette page n'est plus accessible.
Ce lien a expiré.
Ce lien de partage a expiré.
Le dossier de partage a expiré.
La page a été supprimée.
Le document a été supprimé.
La page a été supprimée ou déplacée.
Le document a été supprimé ou déplacé.
La page n'a pas été trouvée.
La page n'a pas pu être chargée.
Le document n'a pas pu être trouvé.
Le fichier n'a pas pu être ouvert.
Une erreur est survenue.
Une erreur interne est survenue.
Une erreur inattendue est survenue.
Une erreur s'est produite.
Une erreur interne s'est produite.
Une erreur interne s'est produite (12).
Une erreur interne est survenue (12).
Votre session a expiré.
Votre session a expiré, veuillez vous reconnecter.
La página no se ha encontrado.
El documento no se ha encontrado.
La página no se ha podido cargar.
El documento no se ha podido abrir.
La página no está disponible.
El documento ya no está disponible.
La página no está disponible, inténtelo más tarde.
El documento no está disponible, inténtelo más tarde.
La página no existe.
La página ya no existe.
El enlace no es válido.
El enlace ya no es válido.
El enlace ha caducado.
Este enlace ha expirado.
La página ha sido eliminada.
El documento ha sido eliminado.
El documento ha sido eliminado o movido.
La página ha sido movida o eliminada.
Se produjo un error.
Se produjo un error interno.
Se produjo un error interno (12).
Se produjo un error interno (7f3a).
Inténtelo más tarde.
Inténtelo de nuevo más tarde.
Acceso denegado.
Acceso denegado!
Su sesión ha caducado.
Su sesión ha expirado.
Loading…
Loading...
LOADING…
Chargement…
Chargement...
Cargando…
Cargando...
Wird geladen…
Wird geladen...
Ref 12-34
Ref 7-8
Ref 123-4567
Home | Vault | Help
Home | Help
Menu  Search  Sign in
Menu Search Sign in
Menu | Search | Sign in
Back to list
Back to home
Back to start
Zurück zur Startseite
Volver al inicio
Retour à l'accueil
""",
    "notice": """
Please enable JavaScript.
Please enable JavaScript to view this page.
Please turn on scripts to open the document.
Please allow cookies and scripts to use this site.
You need to enable JavaScript.
You need to enable JavaScript to run this app.
You need to turn on scripts to run this app.
You must enable JavaScript to view this page.
You must allow cookies to use this site.
Enable JavaScript to view this page.
Turn on scripts in your settings and refresh.
Enable JavaScript and reload.
Enable JavaScript, then reload.
Turn on cookies and scripts, then reload.
To view the page, enable JavaScript in your settings and refresh.
To open this document, turn on scripts in your settings and refresh.
To use the file, allow JS in your settings and refresh.
To view this page, enable JavaScript.
This page requires JavaScript.
This document requires scripts to run.
This site needs JavaScript to work.
This page requires JavaScript, but your browser has it switched off.
The document requires scripts, but your browser has it switched off.
This site needs cookies, but your browser has it switched off.
Your browser does not support JavaScript.
Your browser doesn't support scripts.
Browser does not support JavaScript.
Without JavaScript we can not open this page.
Without scripts we cannot load the document.
Without cookies we cannot show this page.
No JavaScript: panels stay blank until you enable it.
No scripts: panels stay blank until you turn on it.
No JS: panels stay blank until you allow it.
JavaScript is disabled.
JavaScript is disabled in your browser.
Scripts are switched off in your browser.
JavaScript has been blocked by your browser.
JavaScript has been disabled.
Bitte aktivieren Sie JavaScript.
Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.
Bitte aktivieren Sie Cookies, um dieses Dokument zu öffnen.
Diese Seite benötigt JavaScript.
Diese Anwendung benötigt Scripts.
Ohne JavaScript kann die Seite nicht geladen werden.
Ohne Scripts kann das Dokument nicht geladen werden.
JavaScript ist in Ihrem Browser deaktiviert.
JavaScript ist in Ihrem Browser ausgeschaltet.
Cookies sind in Ihrem Browser abgeschaltet.
Ihr Browser unterstützt kein JavaScript.
Ihr Browser unterstützt keine Scripts.
Veuillez activer JavaScript.
Veuillez activer JavaScript pour afficher cette page.
Veuillez activer les scripts pour ouvrir ce document.
Cette page nécessite JavaScript.
Cette application nécessite JavaScript.
Sans JavaScript, cette page ne peut pas être affichée.
Sans scripts, la page ne peut pas être chargée.
JavaScript est désactivé dans votre navigateur.
Les cookies sont désactivés dans votre navigateur.
Votre navigateur ne prend pas en charge JavaScript.
Votre navigateur ne prend pas en charge les scripts.
Active JavaScript para ver esta página.
Active los scripts para abrir este documento.
Habilite JavaScript para ver esta página.
Habilite JavaScript.
Esta página necesita que JavaScript esté habilitado.
Esta aplicación necesita que los scripts estén habilitados.
Su navegador tiene desactivado JavaScript.
Su navegador no admite JavaScript.
Su navegador no es compatible con JavaScript.
JavaScript está desactivado en su navegador.
JavaScript está deshabilitado en su navegador.
""",
}
#: Words that take each other's place in residue, by the name of their class.
ALIKE = {
    # what is asked for, and what is done to it
    "it": "page note document link view vault attachment file image site app application folder map article item content server board list panel record entry website index database "
    "edit open load use see read display show render run respond "
    "seite notiz dokument anhang ansicht ordner datei bild anwendung webseite verknüpfung eintrag tabelle karte sehen öffnen laden bearbeiten anzeigen lesen nutzen verwenden "
    "fichier vue dossier lien pièce tableau élément afficher ouvrir voir charger lire modifier utiliser consulter "
    "página nota documento adjunto vista carpeta enlace archivo aplicación imagen tabla elemento ver abrir cargar editar leer usar consultar",
    "doing": "opening rendering viewing editing showing",
    "enable": "enable activate allow reactivate",
    "script": "javascript js script scripts scripting cookies",
    "the": "the this that die das der diese dieses dieser dem den la le les cette ce cet el los las esta este",
    "sorry": "sorry oops whoops",
}
#: The same for two words.
ALIKE_PAIRS = {"it": "table view, shared folder, pièce jointe, web page, dossier partagé, carpeta compartida", "enable": "turn on, switch on", "script": "java script", "cannot": "can not, could not", "sorry": "oh no, uh oh, nothing here"}
#: Words that residue may hold or not.
OPTIONAL = "you asked for, you requested, you are looking for, you tried to open, at this address, behind this link"
#: Words that frame the name in a slot, and names of fields in capitals.
FRAME = frozenset("insert add enter your put write fill in here goes go einfügen eintragen einsetzen hier insérer à remplir saisir ici insertar rellenar completar aquí".split())
FIELD = frozenset("text title name date content summary topic description".split())
#: Words of the common Latin filler, and words that are typed to fill a place.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum porta justo felis massa vitae dictum augue urna "
    "nisl semper ornare lectus vestibulum pellentesque curabitur mauris donec praesent vivamus nunc fusce maecenas nullam integer aenean cras".split()
)
DUMMY = frozenset("tbd todo test asdf blah xxx xxxx foo qwerty dummy".split())
